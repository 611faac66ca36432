"""Mergeable quantile sketches (KLL) beside exact percentiles.

``percentile`` keeps every distinct value of a group; a sketch keeps some hundreds however many there
are, and sketches of parts add up, so they can be stored by day or file and merged later. With ``k`` of
400 the rank of an answer is off by about 0.7 % of the rows (99 of 100 times); tests measure it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400


def sketched(rows: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """``keys, sketch, n``; null values are left out."""
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    return own.groupBy(*keys).agg(F.expr(f"kll_sketch_agg_double(_v, {k})").alias("sketch"), F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts as one for each of ``keys``."""
    both = F.aggregate(F.collect_list("sketch"), F.lit(None).cast("binary"), lambda a, s: F.when(a.isNull(), s).otherwise(F.call_function("kll_sketch_merge_double", a, s)))
    return sketches.groupBy(*keys).agg(both.alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """A column ``p50`` and so on for each share."""
    named = [F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(float(s))).alias(f"p{s * 100:g}".replace(".", "_")) for s in shares]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *named)


def exact(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """The same from all values."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), *[F.percentile(value, F.lit(float(s))).alias(f"p{s * 100:g}".replace(".", "_")) for s in shares])
