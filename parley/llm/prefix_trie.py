"""Conversation prefix trie: merged sorted runs with common prefixes, nodes from a stack of open paths.

A turn is a symbol of ``SYMBOL`` bytes (digest of role and text, bytes of the text), a conversation
the path of its symbols. Tasks sort blocks of paths to runs that carry the length of the prefix which
each path shares with the one before (LCP). Runs are dealt by ranges of paths, so Spark's shuffle and
its files are the external part of the sort. A task merges the runs of its range by a tree of losers
that compares paths only from the shared prefix on, and a stack of the open path emits nodes as they
are finished. Only the first and the last path of a range can share nodes with other ranges; such
nodes come as parts, which a last stream over them alone puts together by another stack.

Tables have ``conv_id, turn, role, text``. Rows stand by turn, null first; rows of one turn by role,
then by the digest of role and text. Null roles and texts are empty, repeated rows are repeated turns,
rows with a null id are one conversation (its decimal is the empty text, and it is rebuilt from itself).
An empty table gives an empty result; other columns are not looked at. A conversation's symbols come to
one task; its texts never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import rows as R
from parley.llm.folds import joined_sha256
from parley.session import ship, written

#: Bytes of a turn's symbol: 16 of the digest, 8 of the text's length.
SYMBOL = 24
#: Bytes of paths in a run, and about so many in a range that one task merges.
RUN_BYTES, RANGE_BYTES = 4 << 20, 32 << 20
#: Members of a text of ids that is made before ids meet by path.
IDS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path`` of each conversation as it is."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    told = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit("\0"), role, text), 256), 1, 32)
    symbol = F.concat(told, F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    slim = conversations.select("conv_id", "turn", role.alias("role"), symbol.alias("symbol"))
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull(), "turn", "role", "symbol")))
    return slim.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["symbol"]), "")).alias("path"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Paths with the first turns of a conversation changed to those of ``conv_id - conv_id % 5``; how many
    is ``crc32(conv_id) % 9``."""
    lead = (F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 9 * SYMBOL).cast("int")
    asked = own.select("conv_id", "path", lead.alias("lead"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    given = own.where("conv_id is not null and conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("path").alias("first"))
    nothing = F.lit(b"")
    head = F.when(F.col("conv_id").isNull(), F.substring(F.col("path"), F.lit(1), F.col("lead"))).otherwise(F.coalesce(F.substring(F.col("first"), F.lit(1), F.col("lead")), nothing))
    tail = F.substring(F.col("path"), F.col("lead") + 1, F.octet_length("path"))
    return asked.join(given, "base", "left").select("conv_id", F.concat(head, tail).alias("path"))


def distinct(members: DataFrame) -> DataFrame:
    """``path, conv_id`` (the smallest), ``n, ends`` (digest of all ids, ascending) of each distinct path.

    Copies are dealt by path and id, and each task first joins its ids to texts of many, so that of a
    path that a third of all conversations have only few rows meet.
    """
    ship(members.sparkSession)
    ids = members.select(F.unhex(F.sha2("path", 256)).alias("same"), "conv_id")
    schema = T.StructType([T.StructField("same", T.BinaryType()), ids.schema["conv_id"], T.StructField("nulls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            kind, out = batch.schema.field(1).type, []
            for same, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if same != at or len(held) == IDS:
                    if held:
                        out.append((at, held))
                    at, held = same, []
                held.append(conv)
            yield packed(out, kind)
        if held:
            yield packed([(at, held)], kind)

    def packed(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        said = [",".join("" if x is None else str(x) for x in ids) for _, ids in out]
        least = [min((x for x in ids if x is not None), default=None) for _, ids in out]
        cells = ([k for k, _ in out], pa.binary()), (least, kind), ([int(None in ids) for _, ids in out], pa.int64()), ([len(ids) for _, ids in out], pa.int64()), (said, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in cells], schema.names)

    dealt = ids.repartitionByRange("same", "conv_id").sortWithinPartitions("same", "conv_id")
    texts = written(dealt.mapInArrow(run, schema), "members")
    ends = joined_sha256(texts, F.col("same"), [F.col("conv_id")], F.col("ids"), ",")
    least = texts.groupBy("same").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    found = least.join(ends.select(F.col("key").alias("same"), F.col("sha256").alias("ends")), "same")
    return found.alias("f").join(members.alias("m"), F.col("f.conv_id").eqNullSafe(F.col("m.conv_id"))).select("m.path", "f.conv_id", "f.n", "f.ends")


def shared(a: bytes, b: bytes, known: int) -> int:
    """How many symbols two paths share at their start, of which ``known`` are known."""
    most = min(len(a), len(b)) // SYMBOL
    while known < most and a[known * SYMBOL : (known + 1) * SYMBOL] == b[known * SYMBOL : (known + 1) * SYMBOL]:
        known += 1
    return known


RUN = "run string, place long, lcp long, path binary, conv_id {0}, n long, ends string"


def runs(seqs: DataFrame) -> DataFrame:
    """Sorted runs of distinct paths: ``run, place`` in it, ``lcp`` with the path before in the run."""
    kind = seqs.schema["conv_id"].dataType.simpleString()

    def sort(held: list[tuple], name: str, ids: pa.DataType) -> pa.RecordBatch:
        held.sort(key=lambda r: r[0])
        lcp = [0, *(shared(a[0], b[0], 0) for a, b in zip(held, held[1:], strict=False))]
        cells = ([name] * len(held), pa.string()), (range(len(held)), pa.int64()), (lcp, pa.int64()), ([r[0] for r in held], pa.binary()), ([r[1] for r in held], ids), ([r[2] for r in held], pa.int64()), ([r[3] for r in held], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in cells], ["run", "place", "lcp", "path", "conv_id", "n", "ends"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, size, ids = TaskContext.get().partitionId(), 0, [], 0, pa.int64()
        for batch in batches:
            ids = batch.schema.field(1).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[0]) + 100
                if size >= RUN_BYTES:
                    yield sort(held, f"{part}/{nth}", ids)
                    nth, held, size = nth + 1, [], 0
        if held:
            yield sort(held, f"{part}/{nth}", ids)

    return seqs.select("path", "conv_id", "n", "ends").mapInArrow(run, RUN.format(kind))


def merged(streams: list[list[tuple]]) -> Iterator[tuple[int, tuple]]:
    """Rows ``(lcp, path, ...)`` of sorted runs as one sorted stream of (LCP with the row before, row).

    A tree of losers: inner nodes hold the run that lost there and what its path shares with the path
    that won. Of two paths whose shared prefixes with the last one out differ, the one that shares more
    is smaller, and only where they are equal are symbols compared, from there on.
    """
    k = 1
    while k < len(streams):
        k *= 2
    at = [0] * k
    share = [0] * k

    def path(r: int) -> bytes | None:
        return streams[r][at[r]][1] if r < len(streams) and at[r] < len(streams[r]) else None

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes that with the winner."""
        x, y = path(a), path(b)
        if y is None:
            return a, b
        if x is None:
            return b, a
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        both = shared(x, y, share[a])
        won, lost = (a, b) if x[both * SYMBOL :] <= y[both * SYMBOL :] else (b, a)
        share[lost] = both
        return won, lost

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, losers[node] = duel(build(2 * node), build(2 * node + 1))
        return won

    champion = build(1)
    while path(champion) is not None:
        row = streams[champion][at[champion]]
        yield share[champion], row
        at[champion] += 1
        if path(champion) is not None:
            share[champion] = streams[champion][at[champion]][0]
        node = (champion + k) // 2
        while node:
            champion, losers[node] = duel(champion, losers[node])
            node //= 2


@dataclass
class Node:
    """A node of the open path: its members so far, and what its finished children add up to."""

    told: bytes
    size: int
    conv: object = None
    n: int = 0
    ends: str = NOTHING
    children: int = 0
    leaves: int = 0
    saved: int = 0
    first: bool = False
    kept: list = field(default_factory=list)

    def join(self, conv: object, n: int) -> None:
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.n += n

    def close(self) -> None:
        """To be called once, when no more children come."""
        self.saved += (self.n - 1) * self.size
        self.leaves += not self.children


def _told(parent: bytes, symbol: bytes) -> bytes:
    return hashlib.blake2b(parent + symbol, digest_size=16).digest()


ROOT = _told(b"", b"")
PART = "told binary, up binary, depth long, size long, conv_id {0}, n long, ends string, children long, leaves long, saved long, parent_conv {0}, part long, nth long"


def built(stream: Iterable[tuple[int, tuple]], part: int) -> Iterator[tuple]:
    """Rows of ``PART`` from a sorted stream of (LCP, row): nodes as they are finished, and at the end
    the nodes of the first and the last path, as parts with ``part`` and their order ``nth``.

    A finished node waits on its parent for the parent's smallest member. A part is without what its
    children that are parts add, and not closed.
    """
    stack, firsts = [Node(ROOT, 0, first=True)], []

    def finish() -> Iterator[tuple]:
        node, up = stack.pop(), stack[-1]
        up.join(node.conv, node.n)
        depth = len(stack)
        if node.first:
            firsts.append((depth, up.told, node))
        else:
            node.close()
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved
            up.kept.append((node.told, up.told, depth, node.size, node.conv, node.n, node.ends, node.children, node.leaves, node.saved))
        yield from ((*row, None if node.first else node.conv, None, None) for row in node.kept)
        node.kept = []

    begun = False
    for lcp, (_, path, conv, n, ends) in stream:
        while len(stack) > lcp + 1:
            yield from finish()
        for a in range((len(stack) - 1) * SYMBOL, len(path), SYMBOL):
            symbol = path[a : a + SYMBOL]
            stack.append(Node(_told(stack[-1].told, symbol), int.from_bytes(symbol[16:], "big"), first=not begun))
        begun = True
        stack[-1].join(conv, n)
        stack[-1].ends = ends
    if not begun:
        return
    lasts = []
    while len(stack) > 1:
        node = stack.pop()
        stack[-1].join(node.conv, node.n)
        lasts.append((len(stack), stack[-1].told, node))
    lasts.append((0, None, stack[0]))
    order = sorted((x for x in firsts + lasts if x[2].first), key=lambda x: x[0]) + [x for x in lasts[::-1] if not x[2].first]
    for nth, (depth, up, node) in enumerate(order):
        yield from ((*row, None, None, None) for row in node.kept)
        yield node.told, up, depth, node.size, node.conv, node.n, node.ends, node.children, node.leaves, node.saved, None, part, nth


def _batch(rows: list[tuple], ids: pa.DataType, names: list[str]) -> pa.RecordBatch:
    long = pa.int64()
    kinds = [pa.binary(), pa.binary(), long, long, ids, long, pa.string(), long, long, long, ids, long, long]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _emitted(rows: Iterable[tuple], ids: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield _batch(held, ids, names)
            held = []
    if held:
        yield _batch(held, ids, names)


def parts(sorted_runs: DataFrame, ranges: int) -> DataFrame:
    """Merges the runs of each range of paths and builds its nodes (see ``built``)."""
    kind = sorted_runs.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in PART.split(", ")]
    dealt = sorted_runs.repartitionByRange(ranges, "path").sortWithinPartitions("run", "place").select("run", "lcp", "path", "conv_id", "n", "ends")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[str, list[tuple]] = {}
        ids = pa.int64()
        for batch in batches:
            ids = batch.schema.field(3).type
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                streams.setdefault(name, []).append(tuple(row))
        if streams:
            yield from _emitted(built(merged(list(streams.values())), TaskContext.get().partitionId()), ids, names)

    return dealt.mapInArrow(run, PART.format(kind))


def united(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The nodes that ranges share, from their parts in order: a stack of the open path again. A node that
    is there takes what a further part adds; another one at its depth finishes it and all below it."""
    stack: list[tuple] = []

    def finish() -> tuple:
        depth, up, node = stack.pop()
        node.close()
        if stack:
            above = stack[-1][2]
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
        return node.told, up, depth, node.size, node.conv, node.n, node.ends, node.children, node.leaves, node.saved, None, None, None

    for told, up, depth, size, conv, n, ends, children, leaves, saved, *_ in rows:
        if not (depth < len(stack) and stack[depth][2].told == told):
            while len(stack) > depth:
                yield finish()
            stack.append((depth, up, Node(told, size)))
        node = stack[depth][2]
        node.join(conv, n)
        node.ends = node.ends if ends == NOTHING else ends
        node.children, node.leaves, node.saved = node.children + children, node.leaves + leaves, node.saved + saved
    while stack:
        yield finish()


def trie(members: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``conv_id, path``: ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = members.sparkSession
    ship(spark)
    seqs = written(distinct(written(members, "paths")), "sequences")
    held = seqs.agg(F.coalesce(F.sum(F.octet_length("path") + 100), F.lit(0))).first()[0]
    found = written(parts(runs(seqs), int(held // RANGE_BYTES) + int(spark.conf.get("spark.sql.shuffle.partitions"))), "nodes")
    names = found.columns
    kind = found.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(iter(batches), None)
        if first is not None:
            ids = first.schema.field(4).type
            flat = (row for b in (x for y in ([first], batches) for x in y) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield from _emitted(united(flat), ids, names)

    open_parts = found.where("part is not null").repartition(1).sortWithinPartitions("part", "nth")
    spine = written(open_parts.mapInArrow(run, PART.format(kind)), "spine")
    above = R.near(spine.select(F.col("told").alias("_up"), F.col("conv_id").alias("_conv")), spine.count())
    nodes = found.where("part is null").unionByName(spine)
    on_spine = nodes.join(above, nodes["up"] == above["_up"], "left")
    own = F.coalesce("_conv", "parent_conv")
    return on_spine.select("conv_id", "depth", own.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
