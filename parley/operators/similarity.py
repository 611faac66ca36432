"""Speaker search: exact, by random-projection buckets, and cluster statistics by vector sums."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import vector as V
from parley.operators.vector_index import VectorIndex
from parley.session import ship

#: Rows and queries of a block that meet in one task step.
ROWS, QUERIES = 2048, 512


def similar_speakers(queries: DataFrame, voices: DataFrame, profiles: DataFrame, least: float, k: int) -> DataFrame:
    """For each query (id, vector) the ``k`` active speakers with the best similarity of at least ``least``:
    best and number of matches. Speakers that are not active are left out before any vector is compared."""
    active = profiles.where("is_active").select("speaker_id", "name")
    best = _speakers(queries, voices.join(active, "speaker_id", "left_semi"), least)
    return top(best, k).join(active, "speaker_id").select("query_id", "speaker_id", "name", "similarity", "matches")


def top(best: DataFrame, k: int) -> DataFrame:
    """The ``k`` best speakers of each query."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "speaker_id"))
    return best.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")


def _packed(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """``rows`` (``names``, ``vector``) in blocks of at most ``most``: lists of the columns, and the unit vectors and
    their sizes as bytes. Rows without a vector are left out."""
    kinds = ", ".join(f"{n} array<{rows.schema[n].dataType.simpleString()}>" for n in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                part = whole.slice(at, most)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(i)])) for i in range(len(names))]
                column = part.column(len(names))
                sizes = np.array(column.value_lengths().to_pylist(), np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays([*lists, pa.array([sizes.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], [*names, "sizes", "flat"])

    own = rows.where("vector is not null").select(*names, V.unit(F.col("vector")).alias("vector"))
    return own.mapInArrow(run, f"{kinds}, sizes binary, flat binary")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of the rows of ``a`` and ``b``, added up in order of the elements, so that a product depends on its two
    rows alone and copies tie."""
    out, part, right = np.zeros((len(a), len(b))), np.empty((len(a), len(b))), np.ascontiguousarray(b.T)
    for j in range(a.shape[1]):
        out += np.multiply(a[:, j, None], right[j], out=part)
    return out


def scored_against(queries: DataFrame, voices: DataFrame, least: float | None = None, over: float | None = None, best: bool = False, other: bool = False) -> DataFrame:
    """``query_id, id, speaker_id, similarity`` of a stated query set (id, vector) against all rows.

    Blocks of vectors that were normalised once meet as matrices; pairs below ``least``, not above ``over`` or (``other``)
    of one id never leave their task. ``best``: of a block only ``query_id, speaker_id, similarity, matches``, the best
    and the number of each speaker's pairs, to be brought together by the caller. Vectors of another size are refused;
    pairs with a null vector have null similarity, which no bound lets pass.
    """
    ship(voices.sparkSession)
    left = _packed(queries.select(F.col("id").alias("query_id"), "vector"), ["query_id"], QUERIES).toDF("query_id", "_sizes", "_flat")
    right = _packed(voices.select("id", "speaker_id", "vector"), ["id", "speaker_id"], ROWS)
    kinds = {n: d.schema[c].dataType.simpleString() for n, d, c in (("query_id", queries, "id"), ("id", voices, "id"), ("speaker_id", voices, "speaker_id"))}
    names = ["query_id", "speaker_id", "similarity", "matches"] if best else ["query_id", "id", "speaker_id", "similarity"]
    out = ", ".join(f"{n} {kinds.get(n, 'double' if n == 'similarity' else 'long')}" for n in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, owners, asked = (batch.column(i)[r].values for i in (0, 1, 4))
                sizes, q_sizes = (np.frombuffer(batch.column(i)[r].as_buffer(), np.int64) for i in (2, 5))
                size = int(sizes[0])
                if (sizes != size).any() or (q_sizes != size).any():
                    raise ValueError(f"vectors have to have {size} elements")
                rows, qs = (np.frombuffer(batch.column(i)[r].as_buffer(), float).reshape(-1, size) for i in (3, 6))
                codes = owners.dictionary_encode()
                order = np.argsort(nth := codes.indices.fill_null(-1).to_numpy(), kind="stable")
                for at in range(0, len(qs), 64):
                    like = _products(qs[at : at + 64], rows)
                    keep = np.ones(like.shape, bool) if least is None else like >= least
                    if over is not None:
                        keep &= like > over
                    if other:
                        keep &= asked.slice(at, 64).to_numpy(zero_copy_only=False)[:, None] != ids.to_numpy(zero_copy_only=False)
                    if best:
                        starts = np.flatnonzero(np.diff(nth[order], prepend=-2))
                        n = np.add.reduceat(keep[:, order], starts, axis=1, dtype=np.int64)
                        top = np.maximum.reduceat(np.where(keep, like, -np.inf)[:, order], starts, axis=1)
                        q, o = np.nonzero(n)
                        columns = [asked.take(pa.array(q + at)), owners.take(pa.array(order[starts[o]])), pa.array(top[q, o]), pa.array(n[q, o])]
                    else:
                        q, o = np.nonzero(keep)
                        columns = [asked.take(pa.array(q + at)), ids.take(pa.array(o)), owners.take(pa.array(o)), pa.array(like[q, o])]
                    yield pa.RecordBatch.from_arrays(columns, names)

    pairs = right.crossJoin(left).mapInArrow(run, out)
    if least is not None or over is not None or best or other:
        return pairs
    asked, own = queries.select(F.col("id").alias("query_id"), "vector"), voices.select("id", "speaker_id", "vector")
    blank = own.where("vector is null").crossJoin(asked.drop("vector")).unionByName(own.where("vector is not null").crossJoin(asked.where("vector is null").drop("vector")))
    return pairs.unionByName(blank.select("query_id", "id", "speaker_id", F.lit(None).cast("double").alias("similarity")))


def _speakers(queries: DataFrame, voices: DataFrame, least: float) -> DataFrame:
    """``query_id, speaker_id, similarity, matches``: each speaker's best and number of rows that are ``least`` alike."""
    each = scored_against(queries, voices, least=least, best=True)
    return each.groupBy("query_id", "speaker_id").agg(F.max("similarity").alias("similarity"), F.sum("matches").alias("matches"))


def reidentify(queries: DataFrame, voices: DataFrame, over: float) -> DataFrame:
    """Per query the speaker of the most similar other vector, strictly above ``over``; else null."""
    pairs = scored_against(queries, voices, over=over, other=True)
    best = pairs.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("id")).alias("n"), "speaker_id")).alias("b"))
    found = best.select("query_id", F.col("b.speaker_id").alias("speaker_id"), F.col("b.similarity").alias("similarity"))
    return queries.select(F.col("id").alias("query_id")).join(found, "query_id", "left")


def lsh_index(voices: DataFrame, hashes: int = 8) -> DataFrame:
    """One row for each vector and one-bit hash: id, speaker_id, bucket (hash and bit)."""
    bits = V.sign_bits(F.col("vector"), hashes)
    return voices.select("id", "speaker_id", F.posexplode(bits).alias("h", "bit")).select("id", "speaker_id", F.concat_ws("_", F.col("h").cast("string"), F.col("bit").cast("string")).alias("bucket"))


def signature(vector: Column, hashes: int = 8) -> Column:
    return F.array_join(F.transform(V.sign_bits(vector, hashes), lambda b: b.cast("string")), "")


def signatures(rows: DataFrame, hashes: int = 8) -> DataFrame:
    """``id, speaker_id, sig``: the one-bit hashes of a vector as the bits of a number."""
    bits = V.sign_bits(F.col("vector"), hashes)
    return rows.select("id", "speaker_id", F.aggregate(bits, F.lit(0), lambda s, b: s * 2 + b).alias("sig"))


def agreeing(queries: DataFrame, agree: int = 1, hashes: int = 8) -> DataFrame:
    """``query_id, sig``: every signature that has ``agree`` bits or more in common with the query's."""
    every = F.sequence(F.lit(0), F.lit(2**hashes - 1))
    own = signatures(queries, hashes)
    fit = F.filter(every, lambda s: hashes - F.bit_count(s.bitwiseXOR(F.col("sig"))) >= agree)
    return own.select(F.col("id").alias("query_id"), F.explode(fit).alias("sig"))


def candidates(queries: DataFrame, voices: DataFrame, agree: int = 1, hashes: int = 8) -> DataFrame:
    """``query_id, id`` of vectors that share ``agree`` buckets or more with the query.

    A query meets whole signatures that agree enough, so the join makes each pair once and no other.
    With one bucket this is the plain or-of-bits index; more prune more and may lose neighbours.
    """
    return signatures(voices, hashes).join(agreeing(queries, agree, hashes), "sig").select("query_id", "id")


def candidate_counts(queries: DataFrame, voices: DataFrame, agree: int = 1, hashes: int = 8) -> DataFrame:
    """``query_id, n``: how many candidates a query has, from the counts of signatures and without pairs."""
    held = signatures(voices, hashes).groupBy("sig").agg(F.count("*").alias("n"))
    return agreeing(queries, agree, hashes).join(F.broadcast(held), "sig").groupBy("query_id").agg(F.sum("n").alias("n"))


def index_without(index: DataFrame, gone: DataFrame, key: str = "speaker_id") -> DataFrame:
    """The index without some speakers."""
    return index.join(gone.select(key).distinct(), key, "left_anti")


def index_replaced(index: DataFrame, fresh: DataFrame, key: str = "speaker_id") -> DataFrame:
    """The index with all entries of the speakers of ``fresh`` (voices) made anew."""
    return index_without(index, fresh, key).unionByName(lsh_index(fresh).select(*index.columns))


def lsh_speakers(queries: DataFrame, voices: DataFrame, hashes: int = 8) -> DataFrame:
    """``query_id, speaker_id``: speakers with a vector in one of the query's buckets; all where there are none.

    Both sides meet in the table of signatures, of which there are two to ``hashes``.
    """
    own = signatures(voices, hashes).select("sig", "speaker_id").distinct()
    held = own.select("sig").distinct().agg(F.collect_set("sig").alias("held"))
    asked = agreeing(queries, 1, hashes).groupBy("query_id").agg(F.collect_set("sig").alias("fit"))
    met = asked.crossJoin(F.broadcast(held)).withColumn("sig", F.array_intersect("fit", "held"))
    met = met.select("query_id", F.explode(F.when(F.size("sig") > 0, F.col("sig")).otherwise(F.col("held"))).alias("sig"))
    return met.join(own, "sig").select("query_id", "speaker_id").distinct()


def lsh_search(queries: DataFrame, voices: DataFrame, index: VectorIndex, least: float, k: int) -> DataFrame:
    """For each query the ``k`` best of its candidate speakers, by the best of all their vectors.

    The vector index finds the speakers that are ``least`` alike; a best starts at 0, so similarities that
    are not above it never match.
    """
    alike = index.owners(queries, max(least, 0.0)).where("similarity > 0").select("query_id", "speaker_id", "similarity")
    return top(alike.join(lsh_speakers(queries, voices), ["query_id", "speaker_id"], "left_semi"), k)


def vector_sums(voices: DataFrame, key: str) -> DataFrame:
    """Per key: n vectors and the sum of their unit vectors (``array<double>``)."""
    each = voices.select(key, F.posexplode(V.unit(F.col("vector"))).alias("i", "x"))
    sums = each.groupBy(key, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sum"))


def cluster_quality(voices: DataFrame, key: str = "speaker_id") -> DataFrame:
    """Mean similarity within and between clusters, from vector sums instead of all pairs."""
    own = vector_sums(voices, key)
    sides = own.select(F.col("n").cast("double").alias("n"), V.dot(F.col("sum"), F.col("sum")).alias("sq"), F.posexplode("sum").alias("i", "x"))
    inner = own.agg(F.sum(V.dot(F.col("sum"), F.col("sum"))).alias("sq"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    whole = sides.groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all_sq"))
    both = inner.crossJoin(whole)
    between = F.col("n") * (F.col("n") - 1) / 2 - F.col("pairs")
    return both.select(F.when(F.col("pairs") > 0, (F.col("sq") - F.col("n")) / 2 / F.col("pairs")).alias("intra"), F.when(between > 0, (F.col("all_sq") - F.col("sq")) / 2 / between).alias("inter"))


def profile_similarity(voices: DataFrame, key: str = "speaker_id") -> DataFrame:
    """Mean similarity over all vector pairs of two profiles a < b; there are few profiles."""
    own = vector_sums(voices, key)
    a = own.select(F.col(key).alias("a"), F.col("n").alias("na"), F.posexplode("sum").alias("i", "x"))
    b = own.select(F.col(key).alias("b"), F.col("n").alias("nb"), F.posexplode("sum").alias("i", "y"))
    pairs = a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return pairs.select("a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("similarity"))


def search(queries: DataFrame, voices: DataFrame, profiles: DataFrame, threshold: float, most: int, include_inactive: bool = False, model: str | None = None, min_quality: float | None = None) -> DataFrame:
    """``query_id, speaker_id, similarity``: for each query the best speakers, at most ``most``.

    Rows are filtered by activity, model and quality before any vector is compared.
    """
    rows = voices if include_inactive else voices.join(profiles.where("is_active"), "speaker_id", "left_semi")
    rows = rows if model is None else rows.where(F.col("model") == model)
    rows = rows if min_quality is None else rows.where(F.col("quality") >= min_quality)
    best = _speakers(queries, rows, threshold).drop("matches")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "speaker_id"))
    return best.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def matches(queries: DataFrame, voices: DataFrame, threshold: float) -> DataFrame:
    """Every row that is ``threshold`` alike to a query, with its place among that query's matches."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return scored_against(queries, voices, least=threshold).withColumn("place", rank)
