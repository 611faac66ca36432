"""Suffix-array dedup: bytes of every stretch of ``LENGTH`` bytes that starts in two places go.

Distinct texts are kept once, bucketed by digest (half a SHA-256). A stretch is told by its lowest k-mer (the anchor),
so equal stretches share anchor and offset, and consecutive stretches with one anchor form one
string. Strings meet by anchor; those equal as a whole, told by 128-bit digests of their bytes, count
as one string with a weight. The strings of an anchor are merged in ``suffix_merge``, whose repeated intervals are the stretches to remove.
A group of too many strings is first cut finer: stretches that start equally far before the anchor,
give or take a few bytes, share all bytes but those few, so the shared ones name a smaller group.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import rows, suffix_merge, words
from parley.session import discard, shared_dir, ship, written

#: Bytes of a stretch, and of the k-mers that are anchors.
LENGTH, KMER = 200, 32
#: Strings that are merged together; larger groups are cut finer.
GROUP_STRINGS = 2000
#: Starts that one band of a string holds, for each cut; equal stretches fall into equal bands. In a band
#: of one start all strings of a group are equal, so no group is left to cut after the last.
BANDS = (24, 4, 1)
#: Bytes of the digest that tells texts apart.
REF = 16
#: Bytes of strings that are merged at once, besides the last group.
UNIT = 45_000
#: An anchor is dealt out over parts if it is more than one in so many of a sample of texts; its parts
#: are about that small.
HOT_SHARE, HOT_SAMPLE = 10_000, 0.02

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
MEMBER = "ref binary, start int, size int, run int, weight int, key long, own binary"
#: Where an anchor is in its string, as bytes for the digest of the string.
_SEAT = [struct.pack("<H", i) for i in range(2 * LENGTH)]


def _mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[k]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1 - k]
    return x ^ (x >> np.uint64(32))


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def anchored(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Strings of a block: text, start, size, run, anchor hash, digest of the string and its anchor's place.

    ``run`` strings start one byte after the other and are all equal (a run of one byte).
    """
    sizes = np.array([len(v) for v in values])
    base = np.cumsum(sizes) - sizes
    joined = b"".join(values)
    raw = np.frombuffer(joined, np.uint8)
    n = len(raw)
    starts = np.maximum(0, sizes - LENGTH + 1)
    if not starts.sum():
        return *((np.empty(0, np.int64),) * 5), []
    up, down = words.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    code = _mix((sums[KMER:] - sums[:-KMER]) * down[: n + 1 - KMER])
    width = LENGTH - KMER + 1
    rank = (code >> np.uint64(24) << np.uint64(24)) | np.arange(len(code), dtype=np.uint64)
    pad = np.full(-len(rank) % width + width, np.iinfo(np.uint64).max, np.uint64)
    grid = np.concatenate((rank, pad)).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    text = np.repeat(np.arange(len(values)), starts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts) + base[text]
    anchor = (np.minimum(back[place], ahead[place + width - 1]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((fresh[1:], [len(text)])) - 1
    start, end = place[fresh], place[last] + LENGTH
    key, seat, text = code[anchor[fresh]], anchor[fresh] - start, text[fresh]
    # a string equals the one a byte before it only if all its bytes are one
    flat = np.concatenate(([0], np.cumsum(raw[1:] == raw[:-1])))
    one = flat[end - 1] - flat[np.maximum(start, 1) - 1] == end - start
    same = np.concatenate(([False], one[1:] & (text[1:] == text[:-1]) & (start[1:] == start[:-1] + 1) & (end[1:] == end[:-1] + 1) & (seat[1:] == seat[:-1])))
    head = np.flatnonzero(~same)
    run = np.diff(np.concatenate((head, [len(same)])))
    start, end, text = start[head], end[head], text[head]
    own = [_digest(_SEAT[i], joined[a:b]) for i, a, b in zip(seat[head].tolist(), start.tolist(), end.tolist(), strict=True)]
    return text, start - base[text], end - start, run, key[head].view(np.int64), own


def _pieces(values: list[bytes], limit: int) -> Iterator[tuple[int, int, bytes]]:
    """(text, offset, bytes): long texts in pieces that overlap, so that each stretch is in one."""
    for i, value in enumerate(values):
        for a in range(0, max(1, len(value) - LENGTH + 1), limit):
            yield i, a, value[a : a + limit + LENGTH - 1]


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        refs, weights = batch.column(0), batch.column(1).to_numpy()
        for a in range(0, batch.num_rows, 256):
            pieces = list(_pieces([unpack(z.as_py()) for z in batch.column(2).slice(a, 256)], words.BLOCK))
            for x, y in words.blocks([p[2] for p in pieces]):
                piece, start, size, run, key, own = anchored([p[2] for p in pieces[x:y]])
                text = np.array([p[0] for p in pieces[x:y]], np.int64)[piece] + a
                start = start + np.array([p[1] for p in pieces[x:y]], np.int64)[piece]
                weight = np.minimum(2, np.maximum(weights[text], run))
                yield pa.RecordBatch.from_arrays([refs.take(pa.array(text)), *(pa.array(c.astype(np.int32)) for c in (start, size, run, weight)), pa.array(key), pa.array(own, pa.binary())], ["ref", "start", "size", "run", "weight", "key", "own"])


def distinct_texts(docs: DataFrame, text_col: str) -> str:
    """``ref`` (digest), ``copies`` and packed text of each distinct text, as a table in the
    shared folder that is bucketed by ``ref``; ``removed`` drops it once it is done."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{text_col}`").alias("_text")).where(F.octet_length("_text") >= LENGTH)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            values = words.texts(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(v).digest()[:REF] for v in values], pa.binary()), pa.array([shrink(v) for v in values], pa.binary())], ["ref", "packed"])

    grouped = slim.mapInArrow(pack, "ref binary, packed binary").groupBy("ref").agg(F.count("*").alias("copies"), F.first("packed").alias("packed"))
    name = f"stretches_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped.write.bucketBy(buckets, "ref").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name


def _hot(texts: DataFrame) -> dict[int, int]:
    """Anchors so frequent in a sample that their members are dealt out, each over parts (a power of
    two) in proportion to its share; there are at most ``HOT_SHARE``, and this changes no result."""
    counts = texts.sample(HOT_SAMPLE, seed=3).select("ref", "copies", "packed").mapInArrow(_members, MEMBER).groupBy("key").agg(F.count("*").alias("n"))
    counts = written(counts.where("n > 3"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(16, total // HOT_SHARE)
    return {r.key: 1 << (-(-r.n // most) - 1).bit_length() for r in counts.where(F.col("n") > most).collect()}


def _part(hot: dict[int, int]) -> Column:
    """The part of a member of an anchor: hot ones are dealt out by text."""
    part = F.lit(0).cast("long")
    for parts in set(hot.values()):
        own = sorted(k for k, n in hot.items() if n == parts)
        part = F.when(F.col("key").isin(own), F.pmod(F.xxhash64("ref"), F.lit(parts))).otherwise(part)
    return part


def shared_anchors(texts: DataFrame) -> DataFrame:
    """Members (see ``MEMBER``, and ``head``: first of its string) of anchors that occur twice or more."""
    hot = _hot(texts)
    dealt = texts.select("ref", "copies", "packed").mapInArrow(_members, MEMBER).repartition(F.xxhash64("key", _part(hot))).sortWithinPartitions("key", "own")
    often = np.array(sorted(hot), np.int64)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            yield from judged(whole.slice(0, whole.num_rows - 1), before, whole)
            if whole.num_rows > 1:
                before = _ids(whole, whole.num_rows - 2)
            held = whole.slice(whole.num_rows - 1)
        if held is not None:
            yield from judged(held, before, held)

    def judged(rows: pa.RecordBatch, before: tuple | None, whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        n = rows.num_rows
        key, weight = (whole.column(whole.schema.get_field_index(c)).to_numpy() for c in ("key", "weight"))
        own = whole.column(whole.schema.get_field_index("own"))
        equal = pc.equal(own.slice(1), own.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        back = np.concatenate(([before is not None and before[0] == key[0]], key[1:] == key[:-1]))
        ahead = np.concatenate((back[1:], [False]))
        alike = np.concatenate(([before is not None and before == (key[0], own[0].as_py())], (key[1:] == key[:-1]) & equal))
        twice = np.maximum(weight, np.where(np.concatenate((alike[1:], [False])), 2, 1))
        stay = (back | ahead | (weight > 1) | np.isin(key, often))[:n]
        out = rows.set_column(rows.schema.get_field_index("weight"), "weight", pa.array(twice[:n].astype(np.int32))).append_column("head", pa.array(~alike[:n]))
        yield out.filter(pa.array(stay))

    return written(dealt.mapInArrow(keep, MEMBER + ", head boolean"))


def _ids(batch: pa.RecordBatch, i: int) -> tuple[int, bytes]:
    return batch.column(5)[i].as_py(), batch.column(6)[i].as_py()


STRING = "key long, own binary, weight int, many int, place int, string binary"
BAND = "key long, own binary, off int, part long, print binary, weight int, place int, string binary"
RESULT = "key long, own binary, starts array<int>, ends array<int>"


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of each text (columns packed, asked) as rows; the anchor's place is not yet known."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["key", "own", "weight", "many", "place", "string"]
    for batch in batches:
        for packed, asked in zip(batch.column(0), batch.column(1), strict=True):
            text, rows = unpack(packed.as_py()), asked.as_py()
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], k) for c, k in (("key", pa.int64()), ("own", pa.binary()), ("weight", pa.int32()), ("many", pa.int32()))), pa.array([-1] * len(rows), pa.int32()), pa.array([text[r["start"] : r["start"] + r["size"]] for r in rows], pa.binary())], names)


def _ranges(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Stretches from consecutive starts as byte ranges."""
    if not len(starts):
        return [], []
    edge = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate(([0], edge + 1))].tolist(), (starts[np.concatenate((edge, [len(starts) - 1]))] + LENGTH).tolist()


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of strings, in units, through the merged transforms."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = [_ranges(x) for x in suffix_merge.repeated([r[3] for r in rows], np.array([r[2] for r in rows]), LENGTH)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), *(pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1))], ["key", "own", "starts", "ends"])

    unit: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held >= UNIT and row[0] != unit[-1][0]:
                yield solve(unit)
                unit, held = [], 0
            unit.append(row)
            held += len(row[3])
    if unit:
        yield solve(unit)


def anchor_place(string: bytes, key: int) -> int:
    """Where the anchor of a string is: its first k-mer with that hash."""
    up, down = words.powers(len(string) + 1)
    sums = np.zeros(len(string) + 1, np.uint64)
    np.cumsum((np.frombuffer(string, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(string)], out=sums[1:])
    code = _mix((sums[KMER:] - sums[:-KMER]) * down[: len(string) + 1 - KMER])
    return int(np.flatnonzero(code.view(np.int64) == key)[0])


def bands(string: bytes, key: int, place: int, width: int) -> Iterator[tuple[int, int, bytes, int, bytes]]:
    """``off, part, print, place, bytes`` of each band of a string.

    Band ``i`` has the stretches that start ``i * width`` to ``(i + 1) * width - 1`` bytes before the
    anchor. Its part is a hash of the bytes that all these stretches share, which only names a group; its
    print is a digest of all its bytes.
    """
    last = len(string) - LENGTH
    for band in range((place - last) // width, place // width + 1):
        low, high = place - (band + 1) * width + 1, place - band * width
        off, end = max(0, low), min(last, high) + LENGTH
        head, piece = struct.pack("<qi", key, band), string[off:end]
        part = int.from_bytes(_digest(head, string[high : low + LENGTH])[:8], "little", signed=True)
        yield off, part, _digest(head, struct.pack("<i", place - off), piece), place - off, piece


def _banded(width: int):
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in BAND.split(", ")]

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                rows = []
                for key, own, weight, place, string in zip(*(c.to_pylist() for c in batch.slice(a, 2000).columns), strict=True):
                    at = anchor_place(string, key) if place < 0 else place
                    rows += [(key, own, off, part, mark, weight, seat, piece) for off, part, mark, seat, piece in bands(string, key, at, width)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return split


def _groups(strings: DataFrame, key: str, own: str, least: Column) -> DataFrame:
    """Distinct strings with capped weight, one occurrence (``at``), and the size ``many`` of their group;
    groups in which nothing is twice are left out."""
    each = written(strings.groupBy(key, own).agg(F.least(F.sum("weight"), F.lit(2)).cast("int").alias("weight"), F.min(least).alias("at")))
    many = written(each.groupBy(key).agg(F.count("*").cast("int").alias("many"), F.sum("weight").alias("_all")).where("_all > 1").drop("_all"))
    # strings of large groups stay where they are, so that no task gets a whole large group
    large = many.where(F.col("many") > GROUP_STRINGS)
    large = rows.near(large, large.count())
    rest = each.join(large.select(key), key, "left_anti").join(many.where(F.col("many") <= GROUP_STRINGS), key)
    return rest.unionByName(each.join(large, key))


def solved(strings: DataFrame, widths: tuple[int, ...] = BANDS) -> DataFrame:
    """``RESULT`` for groups of two strings and more (columns ``STRING``, a written table).

    Groups within ``GROUP_STRINGS`` are merged. Strings of larger ones are cut into bands, bands that
    are equal become one with a weight, and the groups of bands are solved in the same way.
    """
    columns = ["key", "own", "weight", "string"]
    small = strings.where(F.col("many") <= GROUP_STRINGS) if widths else strings
    merged = small.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(_merge, RESULT)
    large = strings.where(F.col("many") > GROUP_STRINGS)
    if not widths or large.isEmpty():
        return merged
    cuts = written(large.select("key", "own", "weight", "place", "string").mapInArrow(_banded(widths[0]), BAND), "bands")
    groups = _groups(cuts, "part", "print", F.struct("key", "own", "off", F.octet_length("string").alias("size")))
    alone = groups.where("many = 1").select("part", "print", F.array(F.lit(0)).alias("starts"), F.array("at.size").alias("ends"))
    asked = groups.where("many > 1").select("part", "print", "at.key", "at.own", "at.off", F.col("weight").alias("_weight"), "many")
    inner = cuts.join(asked, ["part", "print", "key", "own", "off"])
    inner = solved(written(inner.select(F.col("part").alias("key"), F.col("print").alias("own"), F.col("_weight").alias("weight"), "many", "place", "string")), widths[1:])
    found = alone.unionByName(inner.select(F.col("key").alias("part"), F.col("own").alias("print"), "starts", "ends").where(F.size("starts") > 0))
    shifted = [F.transform(c, lambda x: x + F.col("off")).alias(c) for c in ("starts", "ends")]
    return merged.unionByName(cuts.select("part", "print", "key", "own", "off").join(found, ["part", "print"]).select("key", "own", *shifted))


def repeats(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Byte ranges to remove, for each string that has any: ``RESULT``."""
    strings = _groups(members.where("head"), "key", "own", F.struct("ref", "start", "size"))
    alone = strings.where("many = 1").select("key", "own", F.array(F.lit(0)).alias("starts"), F.array("at.size").alias("ends"))
    asked = strings.where("many > 1").groupBy("at.ref").agg(F.collect_list(F.struct("key", "own", "weight", "many", "at.start", "at.size")).alias("asked"))
    cut = written(asked.join(texts.select("ref", "packed"), "ref").select("packed", "asked").mapInArrow(_cut_out, STRING))
    return written(alone.unionByName(solved(cut)).where(F.size("starts") > 0))


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (columns ref, packed, spans) with merged spans and what is left."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for packed, spans in zip(batch.column(1), batch.column(2), strict=True):
            text = unpack(packed.as_py())
            own = np.array([(s["a"], s["b"]) for s in spans.as_py() or ()], np.int64).reshape(-1, 2)
            own = own[np.argsort(own[:, 0], kind="stable")]
            reach = np.maximum.accumulate(own[:, 1])
            fresh = np.concatenate(([True], own[1:, 0] > reach[:-1]))[: len(own)]
            starts, ends = own[fresh, 0], reach[np.concatenate((fresh[1:], [True]))[: len(own)]]
            kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))
            rows.append((starts.tolist(), ends.tolist(), kept))
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((lists, lists, pa.binary())))], ["ref", "starts", "ends", "kept"])


def removed(docs: DataFrame, text_col: str = "text", columns: list | None = None) -> DataFrame:
    """``ref, starts, ends, kept`` of each distinct text that loses bytes; ``ref`` is its digest.

    The result (or the ``columns`` made of it) is written into the shared folder, and the table of
    distinct texts is dropped.
    """
    spark = docs.sparkSession
    ship(spark)
    name = distinct_texts(docs, text_col)
    try:
        texts = spark.table(name)
        members = shared_anchors(texts)
        found = members.join(repeats(texts, members), ["key", "own"]).select("ref", F.explode(F.arrays_zip("starts", "ends")).alias("r"), "start", "run")
        spans = found.groupBy("ref").agg(F.collect_list(F.struct((F.col("start") + F.col("r.starts")).alias("a"), (F.col("start") + F.col("r.ends") + F.col("run") - 1).alias("b"))).alias("spans"))
        out = spans.join(texts.select("ref", "packed"), "ref").select("ref", "packed", "spans").mapInArrow(_kept, T.StructType.fromDDL("ref binary, starts array<bigint>, ends array<bigint>, kept binary"))
        return written(out.select(*columns) if columns else out, "kept")
    finally:
        spark.sql(f"drop table if exists {name}")
        discard(spark, f"{shared_dir(spark)}/{name}")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.unhex(F.substring(F.sha2(text, 256), 1, 2 * REF)).alias("_ref"))


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``_id, starts, ends, kept`` (removed spans and the bytes that are left).

    Null and empty texts, and those shorter than a stretch, lose nothing. Copies of a text lose all
    bytes that a stretch covers, the first one too. A removed span may cut a character, so ``kept``
    is binary. Null and repeated ids stay as they are; an empty table gives an empty result.
    """
    out = _rows(docs, id_col, text_col).join(removed(docs, text_col), F.col("_ref") == F.col("ref"), "left")
    none = F.array().cast("array<bigint>")
    return out.select("_id", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("kept", F.col("_text").cast("binary")).alias("kept"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``_id, n_bytes, n_removed, n_spans, kept_sha256``; texts stay where they are read."""
    rows = _rows(docs, id_col, text_col).select("_id", "_ref", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("_sha"))
    columns = ["ref", F.octet_length("kept").cast("long").alias("_left"), F.size("starts").cast("long").alias("_spans"), F.sha2("kept", 256).alias("_kept")]
    out = rows.join(removed(docs, text_col, columns), F.col("_ref") == F.col("ref"), "left")
    return out.select("_id", "n_bytes", F.coalesce(F.col("n_bytes") - F.col("_left"), F.lit(0)).alias("n_removed"), F.coalesce("_spans", F.lit(0)).alias("n_spans"), F.coalesce("_kept", "_sha").alias("kept_sha256"))
