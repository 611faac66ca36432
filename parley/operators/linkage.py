"""Average linkage of recordings of any size, in rounds over groups of bounded size.

A cluster is the sum of its unit vectors and their number, so the mean similarity of two clusters is one
product. Average linkage can merge all pairs that are nearest to each other at once: what is not merged
does not come nearer by it, so the merges are those of the one-by-one method, only found in another
order.

In a round each cluster gets the list of its nearest ones. It meets all others of its recording block by
block, as matrix products; a task sees two stripes of a recording and gives the best for each cluster,
never a matrix of a recording. Clusters that follow each other to the nearest form a group of at most
``GROUP``, and a task merges within a group for as long as that is sure: the lists say how near anything
outside can be, and what merges is no nearer to it than its parts are on average. So a round does the work
of many, and a recording of no more than ``GROUP`` clusters needs only one, as does what is left of a larger
one at three times as many. Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import vector as V
from parley.session import ship, written

#: Clusters of a block, of a stripe that one task holds, and of a group that one task merges.
BLOCK, STRIPE, GROUP = 1024, 49152, 1000
#: Length of the list of nearest clusters, parts of a stripe whose best are known before lists are made (no
#: fewer than the list is long), and steps (powers of two) that a group follows to the nearest.
NEAR, PARTS, STEPS = 16, 64, 3
#: What rounding may change in a mean similarity, in double and in single precision.
MARGIN, SLACK = 1e-12, 1e-5

_LISTS = "key long, c long, mates array<long>, likes array<double>"
_ROUND = "key long, c long, b long, n long, total array<double>, height double, nth long"


class _Best:
    """The ``k`` most alike of each of some clusters; of tied ones the smallest ids."""

    def __init__(self, ids: np.ndarray, means: np.ndarray, k: int) -> None:
        self.ids, self.means, self.short, self.k = ids, means, means.astype(np.float32), k
        self.like, self.mate = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
        self.high, self.least = np.full((len(ids), PARTS), -np.inf, np.float32), np.empty(0)
        self.waiting, self.many = [], 0

    def look(self, at: slice, like: np.ndarray, flip: bool = False) -> None:
        """Rows ``at`` meet clusters for the first time: the best of each of ``PARTS`` parts is kept; ``flip`` where
        ``like`` has the others as rows."""
        wide = like.shape[0 if flip else 1] // PARTS
        if wide:
            parts = like[: wide * PARTS].reshape(wide, PARTS, -1).max(0).T if flip else like[:, : wide * PARTS].reshape(len(like), wide, PARTS).max(1)
            np.maximum(self.high[at], parts, out=self.high[at])

    def looked(self) -> None:
        """The best of ``k`` parts are ``k`` clusters, so what is less alike than they is not in the lists."""
        self.least = np.partition(self.high, PARTS - self.k, axis=1)[:, PARTS - self.k].astype(float) - SLACK

    def add(self, at: slice, like: np.ndarray, other: _Best, of: slice, flip: bool = False) -> None:
        """Rows ``at`` meet clusters ``of`` the other ones, which come in order of ids. ``like`` is rounded, so it
        only tells which products to compute in double precision."""
        least = np.maximum(self.like[at, -1], self.least[at])
        floor = (least - SLACK).astype(np.float32)
        row, col = _places(like > (floor if flip else floor[:, None]))
        if flip:
            row, col = col, row
        for i in range(0, len(row), 1 << 16):
            r, c = row[i : i + (1 << 16)], col[i : i + (1 << 16)]
            exact = np.einsum("ij,ij->i", self.means[at][r], other.means[of][c])
            fits = exact > least[r]
            self.waiting.append((r[fits] + at.start, other.ids[of][c[fits]], exact[fits]))
            self.many += int(fits.sum())
            if self.many > 2 * self.mate.size:
                self.sort()

    def sort(self) -> None:
        """What has waited goes into the lists; of one row it has come in order of ids."""
        if self.waiting:
            row, mate, like = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            some, row = np.unique(row, return_inverse=True)
            row = np.concatenate((np.repeat(np.arange(len(some)), self.k), row))
            mate, like = np.concatenate((self.mate[some].ravel(), mate)), np.concatenate((self.like[some].ravel(), like))
            order = np.lexsort((-like, row))
            first = order[np.searchsorted(row[order], np.arange(len(some)))[:, None] + np.arange(self.k)]
            self.like[some], self.mate[some], self.waiting, self.many = like[first], mate[first], [], 0

    def batch(self, key: int) -> pa.RecordBatch:
        self.sort()
        fits = self.like > -np.inf
        ends = pa.array(np.concatenate(([0], np.cumsum(fits.sum(1)))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(own[fits])) for own in (self.mate, self.like)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(self.ids), key, np.int64)), pa.array(self.ids), *lists], ["key", "c", "mates", "likes"])


def _meet(one: _Best, two: _Best, size: int) -> None:
    """All pairs of two stripes, or of one with itself, block by block: first to learn what can be in the lists."""
    room = np.empty(size * size, np.float32)

    def blocks() -> Iterator[tuple[slice, slice, np.ndarray]]:
        for y in _cuts(len(two.ids), size):
            for x in _cuts(y.stop if one is two else len(one.ids), size):
                like = np.matmul(one.short[x], two.short[y].T, out=room[: (x.stop - x.start) * (y.stop - y.start)].reshape(x.stop - x.start, -1))
                if one is two and x == y:
                    np.fill_diagonal(like, -np.inf)
                yield x, y, like

    for x, y, like in blocks():
        one.look(x, like)
        if one is not two or x != y:
            two.look(y, like, flip=True)
    for side in (one, two):
        side.looked()
    for x, y, like in blocks():
        if one is not two or x != y:
            two.add(y, like, one, x, flip=True)
        one.add(x, like, two, y)


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true, which is rare: eight at a time are looked at first."""
    if hit.shape[1] % 8:
        return np.nonzero(hit)
    eights = np.flatnonzero(hit.view(np.uint64))
    at, col = np.nonzero(hit.reshape(-1, 8)[eights])
    return divmod(eights[at] * 8 + col, hit.shape[1])


def _bounds(rows: pa.RecordBatch) -> list[int]:
    """Where runs of equal values in the first two columns begin."""
    one, two = (rows.column(x).to_numpy() for x in (0, 1))
    return [0, *(np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1).tolist()]


def _united(rows: pa.RecordBatch, bounds: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` best of all lists of each cluster; its rows follow each other."""
    starts, sizes = bounds[:-1], rows.column(2).value_lengths().to_numpy()
    mate, like = (rows.column(x).flatten().to_numpy(zero_copy_only=False) for x in (2, 3))
    own = np.repeat(np.repeat(np.arange(len(starts)), np.diff(bounds)), sizes)
    order = np.lexsort((mate, -like, own))
    counts = np.bincount(own, minlength=len(starts))
    nth = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = order[nth < k]
    ends = pa.array(np.concatenate(([0], np.cumsum(np.minimum(counts, k)))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[first])) for x in (mate, like)]
    return pa.RecordBatch.from_arrays([*(rows.column(x).take(pa.array(starts)) for x in (0, 1)), *lists], ["key", "c", "mates", "likes"])


def _cuts(n: int, size: int) -> list[slice]:
    return [slice(i, min(i + size, n)) for i in range(0, n, size)]


def lists(clusters: DataFrame, k: int) -> DataFrame:
    """``key, c, mates, likes``: for each cluster (``key, c, n, total``) the ``k`` most alike other ones of its
    key, the nearest first; of tied ones the smallest ids."""
    size = BLOCK
    sizes = clusters.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1")
    many = F.greatest(F.ceil(F.col("_m") / STRIPE), F.least(F.lit(8), F.ceil(F.col("_m") / BLOCK)))
    # told how many parts, or Spark joins small ones, whose work is large; more than cells, so that few share one
    total = sizes.select(many.alias("_many")).agg(F.sum(F.expr("_many * (_many + 1) / 2"))).first()[0]
    parts = max(1, min(4 * int(total or 0), max(1000, int(total or 0))))
    means = clusters.join(F.broadcast(sizes), "key").select("key", F.col("c").cast("long").alias("c"), many.alias("_many"), F.pmod(F.xxhash64("c"), many).alias("_s"), F.transform("total", lambda x: x / F.col("n")).alias("mean"))
    striped = means.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1)))
    cells = striped.select("key", F.least("_s", "_t").alias("i"), F.greatest("_s", "_t").alias("j"), (F.col("_s") > F.col("_t")).alias("late"), "c", "mean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, ([], [])

        def met() -> Iterator[pa.RecordBatch]:
            sides = [_Best(*(np.concatenate(x) for x in zip(*side, strict=True)), k) for side in held if side]
            if cell is not None and (len(sides) == 2 or cell[1] == cell[2]):
                _meet(sides[0], sides[-1], size)
                for side in sides:
                    yield side.batch(cell[0])

        for batch in batches:
            marks = [batch.column(x).to_numpy(zero_copy_only=False) for x in range(4)]
            fresh = np.flatnonzero(np.any([x[1:] != x[:-1] for x in marks], axis=0)) + 1
            for a, b in pairwise([0, *fresh, batch.num_rows] if batch.num_rows else []):
                now = tuple(int(x[a]) for x in marks[:3])
                if now != cell:
                    yield from met()
                    cell, held = now, ([], [])
                held[int(marks[3][a])].append((batch.column(4)[a:b].to_numpy(), _matrix(batch.column(5)[a:b], b - a)))
        yield from met()

    def united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                batch = batch if held is None else pa.concat_batches([held, batch])
                bounds = _bounds(batch)
                # the last cluster of a batch may go on in the next one
                held = batch.slice(bounds[-1])
                if bounds[-1]:
                    yield _united(batch.slice(0, bounds[-1]), np.array(bounds), k)
        if held is not None:
            yield _united(held, np.array([0, held.num_rows]), k)

    each = cells.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "late", "c").mapInArrow(run, _LISTS)
    return each.repartition("key", "c").sortWithinPartitions("key", "c").mapInArrow(united, _LISTS)


def nearest(asked: DataFrame, clusters: DataFrame) -> DataFrame:
    """``key, c, mate, similarity``: for each cluster asked for the most alike other one of its key; ties go to
    the pair with the smallest ids."""
    found = lists(clusters, 1).join(asked.select("key", "c"), ["key", "c"], "left_semi").where(F.size("mates") > 0)
    return found.select("key", "c", F.col("mates")[0].alias("mate"), F.col("likes")[0].alias("similarity"))


def _groups(found: DataFrame) -> DataFrame:
    """``key, c, group``: clusters that end at the same one, each going on to its nearest; of larger groups
    the nearest ``GROUP``, the others are alone. Two that are nearest to each other are together."""
    up = found.where("up is not null").select("key", "c", "up", "like")

    def on(rows: DataFrame) -> DataFrame:
        return rows.join(rows.select("key", F.col("c").alias("up"), F.col("up").alias("_next")), ["key", "up"])

    pair = F.col("_next") == F.col("c")
    ends = on(up).select("key", "c", F.when(pair, F.least("c", "up")).otherwise(F.col("up")).alias("up"), "like", pair.alias("pair"))
    for _ in range(STEPS):
        ends = on(ends).select("key", "c", F.col("_next").alias("up"), "like", "pair")
    ends = written(ends, "ends")
    over = ends.groupBy("key", "up").agg(F.count("*").alias("_m")).where(F.col("_m") > GROUP).select("key", "up")
    group = F.col("up").alias("group")
    if over.isEmpty():
        return ends.select("key", "c", group)
    nth = F.row_number().over(W.partitionBy("key", "up").orderBy(F.desc("like"), F.desc("pair"), "c"))
    nearest = ends.join(over, ["key", "up"], "left_semi").withColumn("_nth", nth).where(F.col("_nth") <= GROUP)
    return ends.join(over, ["key", "up"], "left_anti").select("key", "c", group).unionByName(nearest.select("key", "c", group))


def _merge(ids: np.ndarray, n: np.ndarray, total: np.ndarray, height: np.ndarray, mates: np.ndarray | None, likes: np.ndarray | None) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Merges within a group, whose ids are in order; ``n``, ``total`` and ``height`` are changed. Which
    clusters are left, and for each step its number, the places of ``a`` and ``b``, and the heights.

    ``mates`` and ``likes`` are lists of the nearest over the whole recording, or None where the group is
    the recording. ``out`` is the most that anything outside can be alike.
    """
    every, live, found, step = np.arange(len(ids)), np.ones(len(ids), bool), [], 0
    mean = total / n[:, None]
    like = mean @ mean.T
    like = np.maximum(like, like.T)
    np.fill_diagonal(like, -np.inf)
    out, both = np.full(len(ids), -np.inf), np.zeros(len(ids), bool)
    if mates is not None:
        place = np.minimum(np.searchsorted(ids, mates), len(ids) - 1)
        inside = (ids[place] == mates) & (likes > -np.inf)
        # a full list says that all others are no nearer than its last
        out = np.maximum(np.where(inside, -np.inf, likes).max(1), likes[:, -1])
        first = np.where(inside[:, 0], place[:, 0], every)
        both = (first[first] == every) & (every < first)
    while True:
        if both.any():
            a = np.flatnonzero(both)
            b, top, both = first[a], likes[a, 0], np.zeros(len(ids), bool)
        else:
            near = like.argmax(1)
            best = like[every, near]
            sure = best > out + MARGIN
            a = np.flatnonzero((near[near] == every) & (every < near) & sure & sure[near])
            b, top = near[a], best[a]
        if not len(a):
            return live, found
        height[a] = np.minimum(top, np.minimum(height[a], height[b]))
        found.append((step, a, b, height[a]))
        with np.errstate(invalid="ignore"):
            out[a] = (n[a] * out[a] + n[b] * out[b]) / (n[a] + n[b])
        total[a] += total[b]
        n[a] += n[b]
        mean[a], live[b], step = total[a] / n[a][:, None], False, step + 1
        fresh = mean[a] @ mean.T
        fresh[:, ~live] = -np.inf
        fresh[:, a] = np.maximum(fresh[:, a], fresh[:, a].T)
        fresh[np.arange(len(a)), a] = -np.inf
        like[a], like[:, a] = fresh, fresh.T
        like[b], like[:, b] = -np.inf, -np.inf


def _solved(rows: pa.RecordBatch, bounds: list[int], k: int, first: int) -> pa.RecordBatch:
    """One round over whole groups: what is left and what has merged."""
    keys, ids, n, height = (rows.column(x).to_numpy().copy() for x in ("key", "c", "n", "height"))
    total, known = _matrix(rows.column("total"), len(ids)).copy(), rows.column("mates").is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(known, rows.column("mates").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    fits = np.arange(k) < sizes[:, None]
    mates, likes = np.full(fits.shape, -1, np.int64), np.full(fits.shape, -np.inf)
    mates[fits], likes[fits] = (rows.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("mates", "likes"))
    live, made = np.ones(len(ids), bool), []
    for a, b in pairwise(bounds):
        if b - a > 1:
            own, lists = slice(a, b), (mates[a:b], likes[a:b]) if known[a] else (None, None)
            live[own], steps = _merge(ids[own], n[own], total[own], height[own], *lists)
            made += [(np.full(len(x), first + step), x + a, y + a, high) for step, x, y, high in steps]
    nth, a, b, high = (np.concatenate(x) for x in zip(*made, strict=True)) if made else [np.empty(0, int)] * 4
    left = np.flatnonzero(live)
    vectors = pa.ListArray.from_arrays(pa.array(np.concatenate((np.arange(len(left) + 1) * total.shape[1], np.full(len(a), len(left) * total.shape[1]))).astype(np.int32)), pa.array(total[left].ravel()))
    none = [pa.nulls(x, pa.int64()) for x in (len(left), len(left))]
    columns = [
        pa.array(np.concatenate((keys[left], keys[a]))),
        pa.array(np.concatenate((ids[left], ids[a]))),
        pa.concat_arrays([none[0], pa.array(ids[b].astype(np.int64))]),
        pa.array(np.concatenate((n[left], n[a]))),
        vectors,
        pa.array(np.concatenate((height[left], high)).astype(float)),
        pa.concat_arrays([none[1], pa.array(nth.astype(np.int64))]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["key", "c", "b", "n", "total", "height", "nth"])


def _round(clusters: DataFrame, largest: int, whole: int, first: int) -> DataFrame:
    """One round: what is left (``b`` is null) and what has merged (``c`` and ``b`` into ``c``). Recordings of at
    most ``whole`` clusters are one group."""
    k = NEAR
    if largest > whole:
        large = clusters.groupBy("key").agg(F.count("*").alias("_m")).where(F.col("_m") > whole).select("key")
        listed = lists(clusters.join(F.broadcast(large), "key", "left_semi"), k)
        found = clusters.join(listed, ["key", "c"], "left").withColumns({"up": F.get("mates", F.lit(0)), "like": F.get("likes", F.lit(0))})
        found = written(found, "nearest")
        # a recording without lists is one group
        group = F.coalesce("group", F.when(F.col("mates").isNull(), F.lit(-1)).otherwise(F.col("c")))
        grouped = found.join(_groups(found), ["key", "c"], "left").withColumn("group", group)
    else:
        grouped = clusters.withColumns({"group": F.lit(-1).cast("long"), "mates": F.lit(None).cast("array<long>"), "likes": F.lit(None).cast("array<double>")})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                batch = batch if held is None else pa.concat_batches([held, batch])
                bounds = _bounds(batch)
                # the last group of a batch may go on in the next one
                held = batch.slice(bounds[-1])
                if bounds[-1]:
                    yield _solved(batch.slice(0, bounds[-1]), bounds, k, first)
        if held is not None:
            yield _solved(held, [0, held.num_rows], k, first)

    own = grouped.select("key", "group", "c", "n", "total", "height", "mates", "likes")
    return own.repartition("key", "group").sortWithinPartitions("key", "group", "c").mapInArrow(run, _ROUND)


def merges(vectors: DataFrame) -> DataFrame:
    """``key, a, b, height, nth``: every merge of each recording (``key, id, vector``), down to one cluster. The
    cluster of ``b`` goes into that of ``a``; both are named by their smallest id, so ``a < b``."""
    ship(vectors.sparkSession)
    units = vectors.select("key", F.col("id").cast("long").alias("c"), V.unit(F.col("vector")).alias("total"))
    # copies are as alike as can be, so they merge first; a zero vector is not even like itself
    alone = F.when(F.exists("total", lambda x: x != 0) & ~F.exists("total", F.isnan), F.lit(-1)).otherwise(F.col("c"))
    units, alike = written(units.withColumn("alone", alone), "units"), ["key", "total", "alone"]
    firsts = written(units.groupBy(*alike).agg(F.min("c").alias("a"), F.count("*").alias("n")), "firsts")
    done = written(units.join(firsts.where("n > 1"), alike).where("c > a").select("key", "a", F.col("c").alias("b"), F.lit(1.0).alias("height"), F.lit(0).cast("long").alias("nth")), "copies")
    # what has no direction is like nothing
    clusters = firsts.where(~F.exists("total", F.isnan)).select("key", F.col("a").alias("c"), "n", F.transform("total", lambda x: x * F.col("n")).alias("total"), F.lit(1.0).alias("height"))
    nth = 1
    while True:
        sizes = clusters.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1")
        largest = sizes.agg(F.max("_m")).first()[0]
        if largest is None:
            return done
        # what is left of larger recordings may end in one task earlier; its matrix takes 72 MB
        whole = GROUP if nth == 1 else 3 * GROUP
        out = written(_round(clusters.join(F.broadcast(sizes), "key", "left_semi"), largest, whole, nth), "round")
        made = out.where("b is not null").select("key", F.col("c").alias("a"), "b", "height", "nth")
        if made.isEmpty():
            return done
        done, clusters, nth = done.unionByName(made), out.where("b is null").select("key", "c", "n", "total", "height"), nth + 3 * GROUP


def _roots(ids: DataFrame, kept: DataFrame) -> DataFrame:
    """``key, id, label``: where each id ends, by doubling the pointers ``b`` to ``a``."""
    up = written(ids.join(kept.select("key", F.col("b").alias("id"), "a"), ["key", "id"], "left").select("key", "id", F.coalesce("a", "id").alias("label")), "pointers")
    while True:
        over = up.select("key", F.col("id").alias("label"), F.col("label").alias("_next"))
        jumped = written(up.join(over, ["key", "label"]).select("key", "id", F.col("_next").alias("label"), (F.col("_next") != F.col("label")).alias("moved")), "pointers")
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return up


def label(vectors: DataFrame, similarity: float, least: int, most: int, stop_at_most: bool) -> DataFrame:
    """``key, id, label`` for each vector of recordings (``key, id, vector``), ids in order of time.

    Merges of at least ``similarity`` hold; with ``stop_at_most`` only while more than ``most`` clusters are
    left. What is above ``most`` then merges all the same, and a recording with fewer than ``least``
    clusters has its largest cut at its median time, as often as needed.
    """
    found = merges(vectors)
    sizes = vectors.groupBy("key").agg(F.count("*").alias("_n"))
    counts = found.groupBy("key").agg(F.count("*").alias("_m")).join(sizes, "key")
    # the last merges, of which those must not hold that leave fewer than ``most``
    order = W.partitionBy("key").orderBy("height", F.desc("nth"), F.desc("a"), F.desc("b"))
    last = found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") < max(most, 1)).join(F.broadcast(counts), "key")
    free = last.where(F.col("_k") <= F.col("_m") - F.col("_n") + max(most, 1)).select("key", "b", F.lit(True).alias("_free"))
    held = F.col("_free").isNull()
    kept = found.join(free, ["key", "b"], "left").where(held if stop_at_most else held | (F.col("height") >= similarity))
    out = _roots(vectors.select("key", "id"), kept)
    for _ in range(least - 1):
        counts = out.groupBy("key", "label").agg(F.count("*").alias("_m"))
        per = counts.groupBy("key").agg(F.count("*").alias("_c"), F.max(F.struct("_m", (-F.col("label")).alias("_l"))).alias("_b"), F.max("label").alias("_top"))
        cut = per.where((F.col("_c") < least) & (F.col("_b._m") >= 2)).select("key", (-F.col("_b._l")).alias("label"), F.floor(F.col("_b._m") / 2).alias("_half"))
        nth = F.row_number().over(W.partitionBy("key", "label").orderBy("id"))
        # the later half is named by its own first member
        both = out.join(cut, ["key", "label"], "left").withColumn("_late", F.coalesce(nth > F.col("_half"), F.lit(False)))
        first = F.min("id").over(W.partitionBy("key", "label", "_late"))
        out = written(both.withColumn("_first", first).select("key", "id", F.when(F.col("_late"), F.col("_first")).otherwise(F.col("label")).alias("label")), "labels")
    return out


def numbered(labels: DataFrame) -> DataFrame:
    """``key, id, cluster``: clusters numbered from 0 by their first id."""
    firsts = labels.groupBy("key", "label").agg(F.min("id").alias("_first"))
    place = firsts.withColumn("cluster", (F.row_number().over(W.partitionBy("key").orderBy("_first")) - 1).cast("long"))
    return labels.join(place, ["key", "label"]).select("key", "id", "cluster")
