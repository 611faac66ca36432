"""Greedy groups over ordered rows: a group holds what starts before the end of its first row.

Which row begins a group depends on where the last group began, so the plain form is a fold over a
whole key. Here rows are sorted over ranges, and a piece of consecutive rows tells what it makes of
any end that comes into it: a step function, short because only ends that can come in count. The
functions of consecutive pieces are composed by doubling, in joins of each piece with the one so many
places before, until every piece knows the end that comes into it; then all pieces mark their rows on
their own. A key of any size is spread, and a task holds one piece of each side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import ship, written

#: A piece is at most so many consecutive rows: two to this power.
PIECE_BITS = 12
LOW = -(2**63)

Steps = tuple[np.ndarray, np.ndarray]


def made_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The end that goes out of a piece if its row ``i`` begins a group, for each ``i``."""
    out = ends.copy()
    after = np.searchsorted(starts, ends)
    for i in range(len(starts) - 1, -1, -1):
        # a row whose end is not after its start leaves what follows to begin anew
        at = max(int(after[i]), i + 1)
        if at < len(starts):
            out[i] = out[at]
    return out


def steps(starts: np.ndarray, ends: np.ndarray, limit: int) -> Steps:
    """What comes out for ends up to ``limit`` that come in: (up to which end, what comes out), in order."""
    n = min(len(starts), int(np.searchsorted(starts, limit)) + 1)
    out = made_of(starts, ends)[:n]
    last = np.concatenate((out[1:] != out[:-1], [True]))
    return starts[:n][last], out[last]


def through(fn: Steps, x: np.ndarray) -> np.ndarray:
    """What comes out for ends ``x``; one after the last start passes through."""
    at = np.searchsorted(fn[0], x)
    return np.where(at < len(fn[0]), fn[1][np.minimum(at, len(fn[1]) - 1)], x)


def composed(first: Steps, then: Steps, limit: int) -> Steps:
    """``then`` after ``first``, for ends up to ``limit``."""
    upto, out = first[0], through(then, first[1])
    if len(upto) == 0 or upto[-1] < limit:
        more = then[0] > (upto[-1] if len(upto) else LOW)
        upto, out = np.concatenate((upto, then[0][more])), np.concatenate((out, then[1][more]))
        n = int(np.searchsorted(upto, limit)) + 1
        upto, out = upto[:n], out[:n]
    last = np.concatenate((out[1:] != out[:-1], [True])) if len(out) else np.zeros(0, bool)
    return upto[last], out[last]


_STATE = "nth long, cap long, upto array<long>, free array<long>, value long"


def _each(table: DataFrame, keyed: T.StructField, schema: str, one) -> DataFrame:
    """``one`` gets a row without its first column, and gives the rows that come of it."""
    out = T.StructType([keyed, *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(out)
        for batch in batches:
            for i in range(batch.num_rows):
                key, *row = (c[i].as_py() for c in batch.columns)
                made = [(key, *x) for x in one(*row)]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], f.type) for k, f in enumerate(own)], own.names)

    return table.mapInArrow(run, out)


def began(rows: DataFrame, key: str, start: str, end: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (with ``key, start, end`` not null, whole numbers) and ``at``, which numbers them in order of
    key, start and ``order``, ``begins`` and, per key, the number ``group`` of the group from 0."""
    ship(rows.sparkSession)
    spread = rows.repartitionByRange(key, start, *order).sortWithinPartitions(key, start, *order)
    stored = written(spread.withColumn("at", F.monotonically_increasing_id()), "ordered")
    keyed = stored.schema[key]
    slim = stored.groupBy(key, F.shiftright("at", PIECE_BITS).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("at", F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b")))).alias("rows"))
    order_ = W.partitionBy(key).orderBy("_b")
    cap = F.max("_e").over(order_.rowsBetween(W.unboundedPreceding, -1))
    pieces = slim.select(key, "_b", *[F.col(f"rows.{n}").alias(n) for n in ("at", "a", "b")], F.array_max("rows.b").alias("_e"))
    pieces = written(pieces.withColumn("nth", F.row_number().over(order_).cast("long")).withColumn("cap", cap).drop("_e", "_b"), "pieces")

    def told(nth: int, cap: int | None, a: list[int], b: list[int]) -> Iterator[tuple]:
        starts, ends = np.array(a, np.int64), np.array(b, np.int64)
        if nth == 1:
            yield nth, cap, [], [], int(made_of(starts, ends)[0])
        else:
            upto, free = steps(starts, ends, cap)
            yield nth, cap, upto.tolist(), free.tolist(), None

    state = written(_each(pieces.select(key, "nth", "cap", "a", "b"), keyed, _STATE, told), "steps")
    hop = 1
    while not state.where("value is null").isEmpty():
        open_, done = state.where("value is null"), state.where("value is not null")
        before = state.select(F.col(key).alias("_k"), (F.col("nth") + hop).alias("_n"), *[F.col(c).alias(f"_{c}") for c in ("cap", "upto", "free", "value")])
        both = open_.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("nth") == F.col("_n"))).select(key, "nth", "cap", "upto", "free", "_cap", "_upto", "_free", "_value")

        def joined(nth: int, cap: int, upto: list, free: list, cap0: int | None, upto0: list, free0: list, value0: int | None) -> Iterator[tuple]:
            then = np.array(upto, np.int64), np.array(free, np.int64)
            if value0 is not None:
                yield nth, cap, [], [], int(through(then, np.array([value0]))[0])
            else:
                u, f = composed((np.array(upto0, np.int64), np.array(free0, np.int64)), then, cap0)
                yield nth, cap0, u.tolist(), f.tolist(), None

        state, hop = written(done.unionByName(_each(both, keyed, _STATE, joined)), "steps"), 2 * hop
    comes = state.select(F.col(key).alias("_k"), (F.col("nth") + 1).alias("_n"), "value")
    entered = pieces.join(comes, F.col(key).eqNullSafe(F.col("_k")) & (F.col("nth") == F.col("_n")), "left").select(key, "nth", "at", "a", "b", "value")

    def marked(nth: int, at: list[int], a: list[int], b: list[int], free: int | None) -> Iterator[tuple]:
        starts, ends, kept = np.array(a, np.int64), np.array(b, np.int64), []
        i = 0 if free is None else int(np.searchsorted(starts, free))
        while i < len(a):
            kept.append(i)
            i = max(int(np.searchsorted(starts, ends[i])), i + 1)
        yield nth, len(kept), [at[i] for i in kept]

    marks = written(_each(entered, keyed, "nth long, n long, kept array<long>", marked), "marks")
    so_far = marks.select(key, "nth", "kept", F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    whole = pieces.select(key, "nth", F.col("at").alias("places")).join(so_far.withColumnRenamed(key, "_k").withColumnRenamed("nth", "_n"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("nth") == F.col("_n")))

    def numbered(places: list[int], kept: list[int], base: int) -> Iterator[tuple]:
        own, g = set(kept), base - 1
        for at in places:
            g += at in own
            yield at, at in own, g

    out = _each(whole.select(key, "places", "kept", "_base"), keyed, "at long, begins boolean, group long", numbered).drop(key)
    return stored.join(out, "at")
