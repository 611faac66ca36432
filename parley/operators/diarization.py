"""Who spoke when: stretches of speech, a vector for each, clusters of vectors as speakers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import cluster
from parley.session import written
from parley.sources.audio import statistics_vector

#: Microseconds of a span over which a stream is dealt out (10 days).
SPAN = 864_000_000_000


def with_samples(stretches: DataFrame, frames: DataFrame, key: str = "stream", width: int = SPAN) -> DataFrame:
    """``stretches`` (key, island, start_us, end_us, and others) with the energies of their frames in order as ``samples``.

    Stretches of one key must not overlap, so a frame belongs to the last one that began, if that has not
    ended. Both sides are dealt out over spans of ``width`` microseconds and meet by one sort; a
    stretch has a row in each span that it touches. A stretch without frames is left out.
    """
    span = lambda t: F.floor(t / width).cast("long")
    dealt = stretches.where("start_us < end_us").select(F.col(key), F.struct(*stretches.columns).alias("_s"), F.explode(F.sequence(span(F.col("start_us")), span(F.col("end_us") - 1))).alias("_b"))
    starts = dealt.select(key, "_b", F.greatest("_s.start_us", F.col("_b") * width).alias("_t"), F.lit(0).alias("_of"), "_s", F.lit(None).cast("struct<t:bigint,seq:bigint,energy:double>").alias("_e"))
    point = F.struct(F.col("t_us").alias("t"), F.col("seq").cast("long").alias("seq"), F.col("energy").cast("double").alias("energy"))
    points = frames.select(key, span(F.col("t_us")).alias("_b"), F.col("t_us").alias("_t"), F.lit(1).alias("_of"), F.lit(None).cast(dealt.schema["_s"].dataType).alias("_s"), point.alias("_e"))
    met = starts.unionByName(points).withColumn("_s", F.last("_s", ignorenulls=True).over(W.partitionBy(key, "_b").orderBy("_t", "_of")))
    held = met.where((F.col("_of") == 1) & (F.col("_t") < F.col("_s.end_us"))).groupBy(key, F.col("_s.island").alias("_i")).agg(F.first("_s").alias("_s"), F.array_sort(F.collect_list("_e")).alias("_e"))
    return held.select("_s.*", F.transform("_e", lambda x: x["energy"]).alias("samples"))


def diarize(stretches: DataFrame, frames: DataFrame, similarity: float, most: int, rate: int = 16_000, key: str = "stream") -> DataFrame:
    """Speakers of each stream: ``speaker, segments, time_us, confidence``, and of the stream ``speakers`` and ``overall``.

    Each stretch gets a statistics vector of its samples, made where it is clustered, so only samples are
    moved; speech and samples are found once and written. Average linkage joins stretches that are
    ``similarity`` alike, into at most ``most`` speakers, numbered by their first stretch.
    ``overall`` is the mean of the speakers' mean confidences.
    """
    rows = written(with_samples(stretches, frames, key), "stretches")
    labels = cluster.cluster(rows.select(key, F.col("island").alias("id"), F.col("samples").alias("vector")), key, similarity=similarity, most=most, stop_at_most=False, make=lambda s: statistics_vector(np.asarray(s, float), rate))
    named = rows.drop("samples").join(labels.withColumnRenamed("id", "island"), [key, "island"])
    each = named.groupBy(key, F.col("cluster").alias("speaker")).agg(F.count("*").alias("segments"), F.sum(F.col("end_us") - F.col("start_us")).alias("time_us"), F.avg("confidence").alias("confidence"))
    own = W.partitionBy(key).orderBy("speaker").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return each.withColumn("speakers", F.count("*").over(own)).withColumn("overall", F.avg("confidence").over(own))
