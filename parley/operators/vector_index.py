"""Inverted-file vector index: rows are stored by their nearest centroid, searches read the nearest cells.

Centroids come from spherical k-means over a bounded sample; every row is indexed. Each row also has a
code of sign bits, and in a probed cell only rows whose code is close enough to the query's are scored
in full. How many cells are probed and how close is close enough are calibrated on the sample, so that
data with clusters are pruned by cells and data without by codes. ``exact`` completes a search: it
scores all cells that can still hold something better, by their radius.

Rows are stored in blocks (of bounded bytes, also in a cell that holds a third of all rows), and one
row of a join is a block against a block of queries, scored as a matrix product in NumPy. Null vectors
are not indexed; a zero vector is 0 alike to all; vectors of another size than the index's are refused.
Equal similarities (12 digits) are ordered by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import ship, written

#: Vectors that centroids and calibration may see, and cells at most.
SAMPLE, MAX_CELLS = 8192, 4096
#: Bits of a code, share of true neighbours that probing and codes each must keep in the sample.
BITS, KEPT = 1024, 0.975
#: Bytes of vectors in a block, and queries in a block.
BLOCK_BYTES, QUERY_BLOCK = 2 << 20, 256
DIGITS = 12
#: Rows of query blocks that may be broadcast, by bytes.
SMALL_BYTES = 32 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _kmeans(rows: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from evenly spaced rows, and an empty cell takes the row worst served."""
    centres = rows[np.linspace(0, len(rows) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = rows @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = rows[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def _codes(rows: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sign bits of the projections as 64-bit words."""
    return np.packbits(rows @ planes > 0, axis=1).view(np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all codes of ``a`` and ``b``, word by word."""
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


@dataclass(frozen=True)
class Trained:
    """What the sample told: centroids, planes of the codes, how many cells to probe, sample codes and the
    share of them that a row's code must be among to be scored."""

    centres: np.ndarray
    planes: np.ndarray
    probes: int
    codes: np.ndarray
    share: float


def train(voices: DataFrame, k: int = 10, cells: int | None = None) -> Trained:
    """From at most about ``SAMPLE`` vectors, taken by a hash of the id. ``k``: neighbours that searches want."""
    rows = voices.where("vector is not null").select("id", "vector")
    total = rows.count()
    share = min(1.0, SAMPLE / max(1, total))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("id"), "id").toPandas()["vector"]
    if not len(picked):
        picked = [[1.0]]
    sample = _unit(np.array([list(v) for v in picked], float))
    n, size = sample.shape
    count = cells or max(1, min(MAX_CELLS, round(math.sqrt(total)), n // 8))
    centres = _kmeans(sample, count)
    planes = np.random.default_rng(7).standard_normal((size, BITS))
    codes = _codes(sample, planes)
    asked = np.linspace(0, n - 1, min(n, 256)).astype(int)
    like = sample[asked] @ sample.T
    like[np.arange(len(asked)), asked] = -2
    wanted = max(1, min(n - 1, math.ceil(k * n / max(n, total))))
    best = np.argsort(-like, axis=1, kind="stable")[:, :wanted] if n > 1 else np.zeros((1, 1), int)
    own = (sample @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(sample[asked] @ centres.T), axis=1, kind="stable"), axis=1)
    probes = int(np.quantile(np.take_along_axis(place, own[best], 1), KEPT, method="higher")) + 1
    far = _apart(codes[asked], codes)
    rank = (far[:, None, :] <= np.take_along_axis(far, best, 1)[:, :, None]).mean(2)
    return Trained(centres, planes, probes, codes, min(1.0, float(np.quantile(rank, KEPT, method="higher"))))


def _dots(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product for each row, from that row alone: equal rows get equal bits wherever they stand, which a matrix product does not grant."""
    return np.einsum("ij,j->i", rows, vector)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a list column at length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != size * len(column) or any(n != size for n in column.value_lengths().to_pylist()):
        raise ValueError(f"vectors have to have {size} elements")
    return _unit(flat.reshape(len(column), size))


_ROW = "struct<id: {0}, owner: {1}, unit: binary, code: binary>"


class VectorIndex:
    """An index in the folder ``path``, a folder for each cell. ``ids`` and ``owners`` are the columns' types.

    Writers do not lock: one at a time. A change of a cell replaces the files of that cell alone.
    """

    def __init__(self, spark: SparkSession, path: str, trained: Trained, ids: T.DataType, owners: T.DataType):
        self.spark, self.path, self.trained = spark, path, trained
        self.kinds = ids.simpleString(), owners.simpleString()
        self.size = trained.centres.shape[1]
        ship(spark)
        self._shared = spark.sparkContext.broadcast(trained)

    @classmethod
    def build(cls, voices: DataFrame, path: str, k: int = 10, cells: int | None = None) -> VectorIndex:
        """All rows of ``voices`` (``id, speaker_id, vector``)."""
        out = cls(voices.sparkSession, path, train(voices, k, cells), voices.schema["id"].dataType, voices.schema["speaker_id"].dataType)
        out.add(voices)
        return out

    def add(self, voices: DataFrame) -> None:
        """Further rows, as new blocks of their cells."""
        shared, size = self._shared, self.size
        names = ["cell", "id", "owner", "unit", "code", "near"]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _matrix(batch.column(2), size)
                near = unit @ shared.value.centres.T
                codes = _codes(unit, shared.value.planes)
                cell = near.argmax(1) if len(near) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1), pa.array([v.tobytes() for v in unit], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(near.max(1) if len(near) else np.zeros(0))], names)

        rows = voices.where("vector is not null").select("id", F.col("speaker_id").alias("owner"), F.col("vector").cast("array<double>").alias("vector"))
        placed = written(rows.mapInArrow(run, f"cell int, id {self.kinds[0]}, owner {self.kinds[1]}, unit binary, code binary, near double"), "placed")
        most = max(64, BLOCK_BYTES // (8 * self.size + BITS // 8))
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))
        dealt = placed.withColumn("nth", F.monotonically_increasing_id()).join(F.broadcast(parts), "cell")
        self._packed(dealt.withColumn("part", F.pmod("nth", "parts"))).write.mode("append").partitionBy("cell").parquet(self.path)

    @staticmethod
    def _packed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cell", "part").agg(F.min("near").alias("reach"), F.collect_list(F.struct("id", "owner", "unit", "code")).alias("rows")).select("reach", "rows", "cell")

    def stored(self) -> DataFrame:
        """Blocks: ``reach`` (least similarity to the centroid), ``rows``, ``cell``."""
        return self.spark.read.schema(f"reach double, rows array<{_ROW.format(*self.kinds)}>, cell int").parquet(self.path)

    def remove(self, keys: DataFrame, column: str = "owner") -> list[int]:
        """Rows whose ``owner`` or ``id`` is in ``keys`` (one column) go; gives the cells that were rewritten."""
        gone = keys.toDF("_key").distinct()
        named = self.stored().select("cell", F.explode(f"rows.{column}").alias("_key"))
        cells = sorted(r.cell for r in named.join(gone, "_key", "left_semi").select("cell").distinct().collect())
        if not cells:
            return []
        old = self.stored().where(F.col("cell").isin(cells)).withColumn("part", F.monotonically_increasing_id())
        old = written(old, "blocks")
        each = old.select("cell", "part", F.explode("rows").alias("r")).join(gone, F.col(f"r.{column}") == F.col("_key"), "left_anti")
        left = each.groupBy("part").agg(F.collect_list("r").alias("kept"))
        fresh = old.join(left, "part", "left").select("reach", F.coalesce("kept", F.expr("filter(rows, r -> false)")).alias("rows"), "cell")
        written(fresh, "blocks").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(self.path)
        return cells

    def replace(self, voices: DataFrame) -> None:
        """All rows of the speakers of ``voices`` made anew."""
        self.remove(voices.select("speaker_id"))
        self.add(voices)

    def _asked(self, queries: DataFrame, probes: int | None, share: float | None) -> DataFrame:
        """``cell, q`` for each cell that a query (``id, vector, least``) probes; ``least`` null: the nearest
        ``probes`` cells and codes within ``share``, else all cells that may hold something so alike."""
        reach = {r.cell: r.reach for r in self.stored().groupBy("cell").agg(F.min("reach").alias("reach")).collect()}
        there = np.array(sorted(reach), int)
        radius = np.arccos(np.clip([reach[c] for c in there], -1, 1))
        shared, size = self._shared, self.size
        n_probes, close = probes or self.trained.probes, self.trained.share if share is None else share

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, QUERY_BLOCK):
                    batch = whole.slice(at, QUERY_BLOCK)
                    unit = _matrix(batch.column(1), size)
                    codes = _codes(unit, t.planes)
                    near = unit @ t.centres[there].T if len(there) else np.zeros((len(unit), 0))
                    least = batch.column(2).to_pylist()
                    far = np.sort(_apart(codes, t.codes), axis=1)[:, max(0, math.ceil(close * len(t.codes)) - 1)] if close < 1 else np.full(len(unit), BITS)
                    bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - radius))
                    order = np.argsort(-near, axis=1, kind="stable")
                    for i, query in enumerate(batch.column(0)):
                        own = order[i, :n_probes] if least[i] is None else np.flatnonzero((bound[i] >= least[i] - 1e-9) | (unit[i] == 0).all())
                        n = len(own)
                        limit = far[i] if least[i] is None else BITS
                        yield pa.RecordBatch.from_arrays([pa.array(there[own].astype(np.int32)), pa.array([query.as_py()] * n, batch.schema.field(0).type), pa.array([unit[i].tobytes()] * n, pa.binary()), pa.array([codes[i].tobytes()] * n, pa.binary()), pa.array([int(limit)] * n, pa.int32()), pa.array([least[i]] * n, pa.float64())], ["cell", "id", "unit", "code", "limit", "least"])

        rows = queries.where("vector is not null").select("id", F.col("vector").cast("array<double>"), "least")
        return rows.mapInArrow(run, f"cell int, id {queries.schema['id'].dataType.simpleString()}, unit binary, code binary, limit int, least double")

    def probe(self, queries: DataFrame, k: int | None, other: bool, probes: int | None = None, share: float | None = None) -> DataFrame:
        """``query_id, compared, scored, hits``: for each query and block that met, how many codes were compared
        and rows scored, and the hits: the best ``k``, or without ``k`` each owner's best and number of matches.

        A query's ``least`` bounds its hits. ``other``: not the row whose id is the query's.
        """
        asked = written(self._asked(queries, probes, share), "probes")
        total = asked.count()
        per_cell = max(1, math.ceil(total / max(1, len(self.trained.centres)) / QUERY_BLOCK))
        blocks = asked.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(per_cell))).groupBy("cell", "part").agg(F.collect_list(F.struct("id", "unit", "code", "limit", "least")).alias("qs")).drop("part")
        # a probed cell repeats its query, which files and shuffles compress a hundredfold, so that Spark would take
        # blocks of any size for small ones
        blocks = F.broadcast(blocks) if total * (8 * self.size + BITS // 8) <= SMALL_BYTES else blocks.hint("merge")
        kinds = queries.schema["id"].dataType.simpleString(), *self.kinds
        hit = f"struct<similarity: double, id: {kinds[1]}, owner: {kinds[2]}, n: bigint>"
        out = T.StructType.fromDDL(f"query_id {kinds[0]}, compared bigint, scored bigint, hits array<{hit}>")
        size = self.size

        def one(rows: list[dict], qs: list[dict]) -> Iterator[tuple]:
            units = lambda xs: np.frombuffer(b"".join(x["unit"] for x in xs), float).reshape(len(xs), size)
            codes = lambda xs: np.frombuffer(b"".join(x["code"] for x in xs), np.uint64).reshape(len(xs), BITS // 64)
            left, right = units(qs), units(rows)
            limit = np.array([q["limit"] for q in qs])
            near = _apart(codes(qs), codes(rows)) <= limit[:, None] if (limit < BITS).any() else None
            place = {x["id"]: [] for x in rows}
            for j, x in enumerate(rows):
                place[x["id"]].append(j)
            names = list({x["owner"]: None for x in rows})
            nth = {o: i for i, o in enumerate(names)}
            owner = np.array([nth[x["owner"]] for x in rows])
            for i, q in enumerate(qs):
                own = np.arange(len(rows)) if near is None else np.flatnonzero(near[i])
                like = np.round(np.clip(_dots(right if near is None else right[own], left[i]), -1, 1), DIGITS)
                fits = np.ones(len(own), bool) if q["least"] is None else like >= q["least"]
                if other and q["id"] in place:
                    fits &= ~np.isin(own, place[q["id"]])
                at, like = own[fits], like[fits]
                if k is not None:
                    if len(at) > k:
                        top = like >= np.partition(like, len(like) - k)[len(like) - k]
                        at, like = at[top], like[top]
                    found = sorted(((s, rows[j]) for s, j in zip(like.tolist(), at.tolist(), strict=True)), key=lambda x: (-x[0], x[1]["id"]))
                    hits = [(s, r["id"], r["owner"], 1) for s, r in found[:k]]
                else:
                    best, n = np.full(len(names), -2.0), np.bincount(owner[at], minlength=len(names))
                    np.maximum.at(best, owner[at], like)
                    hits = [(float(best[o]), None, names[o], int(n[o])) for o in np.flatnonzero(n)]
                yield q["id"], len(rows) if near is not None else 0, len(own), hits

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, qs in zip(batch.column(0), batch.column(1), strict=True):
                    made = list(one(rows.as_py(), qs.as_py())) if len(rows) else []
                    kind = pa.list_(pa.struct([("similarity", pa.float64()), ("id", batch.schema.field(0).type.value_type.field("id").type), ("owner", batch.schema.field(0).type.value_type.field("owner").type), ("n", pa.int64())]))
                    hits = pa.array([[dict(zip(("similarity", "id", "owner", "n"), h, strict=True)) for h in m[3]] for m in made], kind)
                    yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], batch.schema.field(1).type.value_type.field("id").type), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), hits], out.names)

        return self.stored().join(blocks, "cell").select("rows", "qs").mapInArrow(run, out)

    @staticmethod
    def best(probed: DataFrame, k: int) -> DataFrame:
        """``query_id, id, similarity, place``: the ``k`` best hits of each query over all its blocks."""
        hits = probed.select("query_id", F.explode("hits").alias("h")).select("query_id", "h.id", "h.similarity")
        return hits.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("place") <= k)

    def search(self, queries: DataFrame, k: int, other: bool = True, exact: bool = False) -> DataFrame:
        """``query_id, id, similarity, place``: the ``k`` most alike rows of each query (``id, vector``).

        ``exact``: the ``k``-th similarity that probing found bounds which cells are scored in full after it.
        """
        plain = queries.select("id", "vector", F.lit(None).cast("double").alias("least"))
        found = self.best(self.probe(plain, k, other), k)
        if not exact:
            return found
        least = found.where(F.col("place") == k).select(F.col("query_id").alias("_q"), F.col("similarity").alias("_s"))
        bounded = queries.join(least, F.col("id") == F.col("_q"), "left").select("id", "vector", F.coalesce("_s", F.lit(-1.0)).alias("least"))
        return self.best(self.probe(bounded, k, other), k)

    def owners(self, queries: DataFrame, least: float, other: bool = False) -> DataFrame:
        """``query_id, speaker_id, similarity, matches``: all speakers with a row at least ``least`` alike."""
        probed = self.probe(queries.select("id", "vector", F.lit(float(least)).alias("least")), None, other)
        hits = probed.select("query_id", F.explode("hits").alias("h"))
        return hits.groupBy("query_id", F.col("h.owner").alias("speaker_id")).agg(F.max("h.similarity").alias("similarity"), F.sum("h.n").alias("matches"))
