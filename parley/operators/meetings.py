"""Meeting lists: search, facets, order, statistics, and the row made of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def search(meetings: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows that hold ``term`` in any of the columns, whatever its case; signs have no meaning."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(term.lower())
    return meetings.where(hit)


def facets(meetings: DataFrame, term: str = "", language: str = "all", quality: str = "all", known: tuple[str, ...] = ("en", "ja")) -> DataFrame:
    """All facets must fit; ``other`` is any language that is not known."""
    out = search(meetings, term, "title") if term else meetings
    if language == "other":
        out = out.where(~F.col("language").isin(*known))
    elif language != "all":
        out = out.where(F.col("language") == language)
    return out if quality == "all" else out.where(F.col("quality") == quality)


ORDERS = {"date": F.desc, "duration_s": F.desc, "speakers": F.desc, "accuracy": F.desc, "title": F.asc, "name": F.asc}


def ordered(meetings: DataFrame, by: str, key: str = "id", descending: bool | None = None) -> DataFrame:
    """Ordered by a column in its usual direction or the one asked for, ties by key."""
    way = ORDERS.get(by, F.asc) if descending is None else F.desc if descending else F.asc
    return meetings.orderBy(way(by), key)


def saved(meetings: DataFrame, fresh: DataFrame) -> DataFrame:
    """The list with meetings put at its end."""
    return meetings.unionByName(fresh)


def storage(files: DataFrame, *by: str) -> DataFrame:
    """Number and bytes of files (size)."""
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def library_stats(meetings: DataFrame) -> DataFrame:
    return meetings.agg(F.count("*").alias("meetings"), F.floor(F.coalesce(F.sum("duration_s"), F.lit(0)) / 3600).cast("long").alias("hours"), F.coalesce(F.sum("speakers"), F.lit(0)).alias("speakers"), F.round(F.avg("accuracy")).cast("long").alias("accuracy"))


def session_rows(segments: DataFrame, preview: int = 100) -> DataFrame:
    """One meeting row for each session: text preview, speakers, accuracy from mean confidence."""
    packed = segments.groupBy("meeting").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"), F.avg("confidence").alias("c"), F.countDistinct("speaker").alias("speakers"), F.max("end_ms").alias("end"), F.min("start_ms").alias("start"))
    text = F.array_join(F.transform("t", lambda s: s["text"]), " ")
    short = F.when(F.char_length(text) > preview, F.concat(F.substring(text, 1, preview), F.lit("..."))).otherwise(text)
    return packed.select("meeting", short.alias("preview"), "speakers", F.round(F.round(100 * F.col("c"), 6)).cast("long").alias("accuracy"), (F.col("end") - F.col("start")).alias("duration_ms"))


def speaker_stats(segments: DataFrame, *keys: str) -> DataFrame:
    """Speaking time, segments and mean confidence of each speaker within ``keys``."""
    return segments.groupBy(*keys, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("time_ms"), F.count("*").alias("n_segments"), F.avg("confidence").alias("mean_confidence"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


def shares(stats: DataFrame, key: str = "meeting") -> DataFrame:
    """``percentage`` of the time of the meeting, and ``before``: that of all speakers with more."""
    whole = W.partitionBy(key)
    above = whole.orderBy(F.desc("time_ms"), "speaker").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("time_ms").over(whole)
    part = stats.withColumn("percentage", F.when(total > 0, 100 * F.col("time_ms") / total).otherwise(0.0))
    return part.withColumn("before", F.coalesce(F.sum("percentage").over(above), F.lit(0.0)))


def dominant(stats: DataFrame, key: str = "meeting") -> DataFrame:
    """The speaker with the most time; ties go to the first name."""
    least = stats.groupBy(key).agg(F.min(F.struct((-F.col("time_ms")).alias("t"), "speaker")).alias("b"))
    return least.select(key, F.col("b.speaker").alias("speaker"), (-F.col("b.t")).alias("time_ms"))
