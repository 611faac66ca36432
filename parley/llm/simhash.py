"""SimHash near-dedup: fingerprints, candidate pairs through pivot distance tables, components.

Distinct fingerprints get a table of Hamming distances to reference fingerprints (pivots), once and in
the JVM, and are dealt out by pigeonhole keys: of ``k`` bit blocks, two fingerprints within ``d``
bits agree on some ``k - d``. In a task the groups of a whole batch are judged together: a pair is
discarded if its largest coordinate difference in the table exceeds ``d``, which the triangle
inequality makes safe; survivors are compared bit by bit. Large keys are cut into parts and each
pair of parts is its own group. Components come from min-label contraction on Spark tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import rows, words
from parley.session import cut, ship

#: Words of a shingle, seed of its hash, most differing bits of a link.
SHINGLE, SEED, BITS = 3, 42, 3
#: Reference fingerprints of the distance tables.
PIVOTS = 24
#: Fingerprints in one part of a pigeonhole key.
PART = 2048
#: Fingerprints that a key should hold on average, at most, if bits are spread evenly.
CROWD = 16
#: Dealt-out fingerprints of one task, at most on average, and pairs that are judged at once.
TASK, PAIRS = 400_000, 2_000_000


def fingerprint_of(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of one text; A-Z are lower-cased, blanks split words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = map(b" ".join, zip(*(parts[i:] for i in range(size)), strict=False)) if len(parts) >= size else [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in joined), np.uint64, max(1, len(parts) - size + 1))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and ``_fp`` (the 64 bits as a signed long) for each row; null text counts as empty."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    schema = slim.select("_id", F.lit(0).cast("long").alias("_fp")).schema

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint_of(t) for t in words.texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], ["_id", "_fp"])

    return slim.mapInArrow(mark, schema)


def pivots(count: int = PIVOTS) -> list[int]:
    """The reference fingerprints, as signed longs."""
    return np.random.default_rng(7).integers(-(2**63), 2**63, count, np.int64).tolist()


def pivot_table(prints: DataFrame, count: int = PIVOTS) -> DataFrame:
    """``prints`` with ``_d``: the Hamming distance to each reference fingerprint, one byte each."""
    far = [F.substring(F.unhex(F.hex(F.bit_count(F.col("_fp").bitwiseXOR(F.lit(p))))), -1, 1) for p in pivots(count)]
    return prints.withColumn("_d", F.concat(*far))


def close_pairs(group: np.ndarray, prints: np.ndarray, table: np.ndarray, bits: int = BITS, seen: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group that are within ``bits``.

    Rows are sorted by group and first coordinate, so pairs whose first coordinates differ too much
    are never made; the other coordinates discard pairs in turn, and what is left is verified.
    ``seen`` counts the pairs made, those left after each coordinate, and those verified.
    """
    place = np.unique(group, return_inverse=True)[1].astype(np.int64) * 256 + table[:, 0]
    order = np.argsort(place, kind="stable")
    place, table, prints = place[order], table[order].astype(np.int8), prints[order]
    many = np.searchsorted(place, place + bits, "right") - np.arange(len(place)) - 1
    upto = np.concatenate(([0], np.cumsum(many)))
    a = 0
    while a < len(place):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        x = np.repeat(np.arange(a, b), many[a:b])
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[a:b] - upto[a], many[a:b])
        left = [len(x)]
        for p in range(1, table.shape[1]):
            stay = np.abs(table[x, p] - table[y, p]) <= bits
            x, y = x[stay], y[stay]
            left.append(len(x))
        sure = np.bitwise_count(prints[x] ^ prints[y]) <= bits
        if seen is not None:
            seen.setdefault("pairs", []).append([*left, int(sure.sum())])
        yield order[x[sure]], order[y[sure]]
        a = b


def forest(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The smallest index reachable from each index over the pairs."""
    label = np.arange(size)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(before, label):
            break
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


def _linked(batch: pa.RecordBatch, bits: int) -> pa.RecordBatch:
    """Links of whole groups of fingerprints: each one with the smallest that it reaches in its group."""
    own = batch.column(0).to_numpy()
    at = np.argsort(own, kind="stable")
    own, group = own[at], batch.column(1).to_numpy()[at]
    table = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(len(own), -1)[at]
    label = np.arange(len(own))
    for x, y in close_pairs(group, own.view(np.uint64), table, bits):
        label = forest(np.concatenate((np.arange(len(own)), x)), np.concatenate((label, y)), len(own))
    linked = own[label] != own
    return pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[label[linked]])], ["a", "b"])


def block_keys(count: int, bits: int = BITS) -> tuple[int, list[tuple[int, ...]]]:
    """How many bit blocks to cut, and the sets of blocks that make up keys."""
    blocks = bits + 1
    while blocks < 8 and count / 2 ** (64 * (blocks - bits) / blocks) > CROWD:
        blocks += 1
    return blocks, list(combinations(range(blocks), blocks - bits))


def links(prints: DataFrame, bits: int = BITS, part: int = PART) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``_fp``), enough to connect each class.

    ``part`` bounds the fingerprints that one group holds of a part.

    Every pair within ``bits`` is connected through the links; pairs that others connect need no
    link of their own. Keys above ``part`` fingerprints are compared part by part, none is left out.
    """
    count = prints.count()
    blocks, sets = block_keys(count, bits)
    edges = [64 * i // blocks for i in range(blocks + 1)]

    def piece(i: int):
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned("_fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1))

    keys = F.array(*[F.xxhash64(F.lit(k), *[piece(i) for i in own]) for k, own in enumerate(sets)])
    keyed = pivot_table(prints).select("_fp", "_d", F.explode(keys).alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_parts", F.ceil(F.col("_n") / part).cast("int"))
    dealt, sized = rows.spread(keyed, "_key", sizes, "_key", "_n", count * len(sets))
    keyed = dealt.join(sized, ["_key", "_salt"]).drop("_salt").withColumn("_own", F.pmod(F.xxhash64("_fp", F.lit(1)), F.col("_parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda i: F.struct(F.least(i, "_own").alias("p"), F.greatest(i, "_own").alias("q")))
    group = F.xxhash64("_key", "_pair.p", "_pair.q").alias("_group")
    dealt = keyed.select("_fp", "_d", F.col("_key"), F.explode(pair).alias("_pair")).select("_fp", group, "_d")
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * len(sets) // TASK))

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(1).to_numpy()
            # the last group of a batch may go on in the next one
            cut_at = int(np.searchsorted(group, group[-1]))
            if cut_at or held and held[-1].column(1)[-1].as_py() != group[-1]:
                yield _linked(pa.concat_batches([*held, batch.slice(0, cut_at)]), bits)
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield _linked(pa.concat_batches(held), bits)

    return dealt.repartition(tasks, "_group").sortWithinPartitions("_group").mapInArrow(solve, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each component, for nodes that have an edge (columns a, b).

    Large-star and small-star steps in turn, each on a checkpointed table, until nothing changes.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_n")))
        dealt, lows = rows.spread(both, "a", low, "a", "_n", low.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
        large = dealt.join(lows, ["a", "_salt"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        now = cut(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct())
        seen = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if seen == state:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        state = seen


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per input row: ``_id, fingerprint, component_id`` (the smallest id of the component).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id belong
    to a component but never name it, unless all ids of it are null (then null). Repeated rows are
    in one component. An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    prints = cut(marked.groupBy("_fp").agg(F.min("_id").alias("_low"), F.count("*").alias("_n")))
    roots = components(links(prints.select("_fp"), bits))
    classed = prints.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_low", "_n", F.coalesce("root", "_fp").alias("_root"))
    named = classed.groupBy("_root").agg(F.min("_low").alias("component_id"))
    member = classed.join(named, "_root").select("_fp", "component_id", "_n")
    dealt, members = rows.spread(marked, "_fp", member, "_fp", "_n", marked.count())
    return dealt.join(members, ["_fp", "_salt"]).select("_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each component, with all columns of ``docs``: the one with the smallest id.

    Of rows with that id the one whose columns have the smallest hash stays, of rows alike in every
    column any one; a null id comes last. Rows are told apart by id and hash, so a repeated id never
    keeps a second document. While those that go are few, they are sent to the rows, which stay
    where they are.
    """
    wide = docs.select(rows.packed(docs).alias("_row"), F.col(f"`{id_col}`").alias("_id"), rows.digest(docs).alias("_tie"), F.col(f"`{text_col}`").alias("_text"))
    key = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_tie").alias("tie"))
    marked = cut(fingerprints(wide.select(key.alias("_key"), "_text"), "_key", "_text"))
    each = marked.groupBy("_fp", "_id").agg(F.count("*").alias("_same"))
    prints = marked.select("_fp").distinct()
    named = each.join(components(links(prints, bits)), F.col("_fp") == F.col("node"), "left").select("_id", "_same", F.coalesce("root", "_fp").alias("_root"))
    best = cut(named.groupBy("_root").agg(F.min("_id").alias("_best"), F.count("*").alias("_n"), F.max("_same").alias("_most")).where("_n > 1 or _most > 1"))
    judged = named.join(rows.near(best, best.count()), "_root").select("_id", "_same", (F.col("_id") == F.col("_best")).alias("_stays")).where("not _stays or _same > 1")
    judged = cut(judged.select(F.col("_id").alias("_which"), "_stays").distinct())
    out = wide.select("_row", key.alias("_key")).join(rows.near(judged, judged.count()), F.col("_key") == F.col("_which"), "left")
    alone = out.where("_which is null").select("_row.*")
    again = out.where("_stays").groupBy("_which").agg(F.first("_row").alias("_row"))
    return alone.unionByName(again.select("_row.*"))
