"""Clustering of the voice vectors of a recording: average linkage and speaker limits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import linkage
from parley.session import ship, written

#: Vectors of a recording that one task clusters; the matrix of their similarities takes 8 MB.
IN_TASK = 1024


def _cosines(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    return unit @ unit.T


def agglomerate(vectors: np.ndarray, least: float, most: int, stop_at_most: bool = True) -> np.ndarray:
    """Labels by average linkage: the closest two clusters merge while they are ``least`` alike.

    With ``stop_at_most`` no more merges happen once there are ``most`` clusters or fewer. Ties go to
    the cluster with the smallest member. Sums of similarities are updated, not computed again.
    """
    n = len(vectors)
    sums, sizes, alive = _cosines(vectors), np.ones(n), np.ones(n, bool)
    label = np.arange(n)
    mean = sums.copy()
    np.fill_diagonal(mean, -np.inf)
    while alive.sum() > 1 and not (stop_at_most and alive.sum() <= most):
        i, j = divmod(int(np.argmax(mean)), n)
        if mean[i, j] < least:
            break
        i, j = min(i, j), max(i, j)
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        sizes[i] += sizes[j]
        alive[j] = False
        label[label == j] = i
        mean[i] = sums[i] / (sizes[i] * sizes)
        mean[:, i] = mean[i]
        mean[i, i] = -np.inf
        mean[j], mean[:, j] = -np.inf, -np.inf
        mean[i, ~alive] = mean[~alive, i] = -np.inf
    return label


def limit(label: np.ndarray, vectors: np.ndarray, times: np.ndarray, least: int, most: int) -> np.ndarray:
    """Between ``least`` and ``most`` clusters: the largest is cut at its median time, the closest merge."""
    label = label.copy()
    while True:
        names, counts = np.unique(label, return_counts=True)
        if len(names) >= least or counts.max(initial=0) < 2:
            break
        own = np.flatnonzero(label == names[np.argmax(counts)])
        late = own[np.argsort(times[own], kind="stable")][len(own) // 2 :]
        label[late] = label.max() + 1
    sims = _cosines(vectors)
    names = np.unique(label)
    own, left = [np.flatnonzero(label == a) for a in names], len(names)
    means, single = np.full((left, left), -np.inf), np.array([len(x) == 1 for x in own])
    firsts = np.array([x[0] for x in own])

    def meet(x: int, y: int) -> None:
        means[x, y] = sims[np.ix_(own[x], own[y])].mean()

    if left > max(most, 1):
        means[:] = np.where(np.triu(np.outer(single, single), 1), sims[np.ix_(firsts, firsts)], -np.inf)
        for x, y in zip(*np.nonzero(np.triu(~np.outer(single, single), 1)), strict=True):
            meet(x, y)
    while left > max(most, 1):
        # of tied pairs the first one
        x, y = divmod(int(means.argmax()), len(own))
        own[x], own[y], left = np.sort(np.concatenate((own[x], own[y]))), own[y][:0], left - 1
        label[own[x]] = names[x]
        means[y], means[:, y] = -np.inf, -np.inf
        # only the means of the merged cluster are new
        for z in range(len(own)):
            if z != x and len(own[z]):
                meet(min(x, z), max(x, z))
    return label


def _numbered(label: np.ndarray) -> np.ndarray:
    """Clusters numbered by their first member in time."""
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def _bounds(keys: pa.Array) -> list[int]:
    """Where each run of one key begins, and the end of all; a null is a key too."""
    known, value = keys.is_valid().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy()
    fresh = (known[1:] != known[:-1]) | (value[1:] != value[:-1])
    return [0, *(np.flatnonzero(fresh) + 1).tolist(), len(keys)]


def cluster(voices: DataFrame, key: str, similarity: float = 0.7, least: int = 1, most: int = 8, stop_at_most: bool = True, in_task: int = IN_TASK, make: Callable[[object], np.ndarray] | None = None) -> DataFrame:
    """``key, id, cluster`` for each vector (id in time order) of each recording, by average linkage.

    A recording of at most ``in_task`` vectors is solved in one task, larger ones in rounds of
    ``linkage``; both give the same clusters. ``make`` turns what column ``vector`` holds into a
    vector, inside the task that needs it.
    """
    ship(voices.sparkSession)
    own = voices.select(F.col(key).alias("key"), "id", "vector")
    sizes = written(own.groupBy("key").agg(F.count("*").alias("_n")), "sizes")
    large = sizes.where(F.col("_n") > in_task).select("key")

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                batch = batch if held is None else pa.concat_batches([held, batch])
                bounds = _bounds(batch.column(0))
                # the last recording of a batch may go on in the next one
                held = batch.slice(bounds[-2])
                yield solved(batch.slice(0, bounds[-2]), bounds[:-1])
        if held is not None:
            yield solved(held, [0, held.num_rows])

    def solved(rows: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        ids, column, out = rows.column(1).to_numpy(), rows.column(2), [np.empty(0, np.int64)]
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for a, b in pairwise(bounds):
            own = [values[ends[i] : ends[i + 1]] for i in range(a, b)]
            vectors = np.array(own if make is None else [make(x) for x in own], float)
            out.append(_numbered(limit(agglomerate(vectors, similarity, most, stop_at_most), vectors, ids[a:b], least, most)))
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.concatenate(out).astype(np.int64))], ["key", "id", "cluster"])

    alone = own.join(large, own["key"].eqNullSafe(large["key"]), "left_anti").select(F.col("key").cast("long"), F.col("id").cast("long"), "vector")
    small = alone.repartition("key").sortWithinPartitions("key", "id").mapInArrow(solve, "key long, id long, cluster long")
    if large.isEmpty():
        return small.withColumnRenamed("key", key)
    rest = own.join(large, "key", "left_semi")
    if make is not None:

        @F.pandas_udf("array<double>")
        def made(values: pd.Series) -> pd.Series:
            return values.map(make)

        rest = written(rest.withColumn("vector", made("vector")), "vectors")
    rounds = linkage.numbered(linkage.label(rest, similarity, least, most, stop_at_most))
    return small.unionByName(rounds).withColumnRenamed("key", key)
