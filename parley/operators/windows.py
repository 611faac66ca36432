"""Order-dependent operators within a group: gaps, switches, islands, folds over sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import greedy


def gaps(rows: DataFrame, least: int, key: str = "meeting") -> DataFrame:
    """Silence between a row and the next one by start, at least ``least`` long."""
    after = F.lead("start_ms").over(W.partitionBy(key).orderBy("start_ms", "seq"))
    out = rows.select(key, F.col("end_ms").alias("gap_start"), after.alias("gap_end"))
    return out.where(F.col("gap_end") - F.col("gap_start") >= least)


def switches(rows: DataFrame, key: str = "meeting") -> DataFrame:
    before = F.lag("speaker").over(W.partitionBy(key).orderBy("start_ms", "seq"))
    return rows.select(key, (F.col("speaker") != before).cast("long").alias("s")).groupBy(key).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("switches"))


def turn_islands(rows: DataFrame, key: str = "meeting") -> DataFrame:
    """Consecutive rows of one speaker as one row."""
    own = W.partitionBy(key).orderBy("seq")
    marked = rows.withColumn("_new", F.coalesce((F.col("speaker") != F.lag("speaker").over(own)).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("_new").over(own))
    return marked.groupBy(key, "island").agg(F.min("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"), F.sum("n_words").alias("n_words"))


def merge_islands(rows: DataFrame, slack: int, key: str = "meeting") -> DataFrame:
    """Rows that start at most ``slack`` after all before them ended, as one row.

    The confidence is the pairwise running mean in order, a fold over the rows of the island.
    """
    own = W.partitionBy(key).orderBy("start_ms", "seq")
    reach = F.max("end_ms").over(own.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start_ms") > reach + slack), 1).otherwise(0)).withColumn("island", F.sum("_new").over(own))
    packed = marked.groupBy(key, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("start_ms", "seq", "confidence"))).alias("_c"))
    values = F.transform("_c", lambda s: s["confidence"])
    mean = F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), lambda a, x: (a + x) / 2)
    return packed.withColumn("confidence", mean).drop("_c")


def word_times(rows: DataFrame, words: Column) -> DataFrame:
    """Each word with an equal part of its segment's time, in whole milliseconds."""
    each = rows.withColumn("_n", F.size(words)).select("*", F.posexplode(words).alias("pos", "word"))
    length = F.col("end_ms") - F.col("start_ms")
    at = lambda k: (F.col("start_ms") + F.floor(length * k / F.col("_n"))).cast("long")
    return each.withColumn("word_start", at(F.col("pos"))).withColumn("word_end", at(F.col("pos") + 1)).drop("_n")


def spaced(rows: DataFrame, least: int, key: str, time: str) -> DataFrame:
    """Of the times of a group those at least ``least`` after the last one kept; null times are left out."""
    slim = rows.select(key, time).where(F.col(time).isNotNull()).withColumn("_end", F.col(time) + least)
    return greedy.began(slim, key, time, "_end").where("begins").select(key, time)


def validity(rows: DataFrame, key: str = "meeting", least: int = 100, most: int = 60_000, late: int = 5_000) -> DataFrame:
    """``valid``: starts at 0 or later, a fair length, and no more than ``late`` before the latest start so far."""
    latest = F.max("start_ms").over(W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    length = F.col("end_ms") - F.col("start_ms")
    return rows.withColumn("valid", (F.col("start_ms") >= 0) & (length > 0) & length.between(least, most) & (latest.isNull() | (F.col("start_ms") >= latest - late)))


def newest(rows: DataFrame, n: int, key: str = "meeting") -> DataFrame:
    """The last ``n`` rows of each group by start: a bounded history."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("start_ms"), F.desc("seq")))).where(F.col("_k") <= n).drop("_k")


def resolve(rows: DataFrame, fill: int, least_gap: int = 100, key: str = "meeting") -> DataFrame:
    """Overlaps resolved in order: one speaker merges, different speakers meet halfway; a small gap is filled.

    A merge ends where the later segment ends, so what happens between two segments depends on these
    two alone, and windows tell it. The confidence of a merge is a fold over its own segments.
    """
    own = W.partitionBy(key).orderBy("start_ms", "seq")
    a, b = F.col("start_ms").cast("double"), F.col("end_ms").cast("double")
    before, after = F.lag(b).over(own), F.lead(a).over(own)
    merges = F.coalesce((a < before) & (F.col("speaker") == F.lag("speaker").over(own)), F.lit(False))
    begin = F.when(a < before, (before + a) / 2).otherwise(a)
    end = F.when(after < b, (b + after) / 2).when((after - b > least_gap) & (after - b < fill), after).otherwise(b)
    marked = rows.select(key, "start_ms", "seq", "speaker", "confidence", begin.alias("_a"), end.alias("_b"), F.when(merges, 0).otherwise(1).alias("_new"))
    marked = marked.withColumn("part", (F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int"))
    packed = marked.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("start_ms", "seq", "_a", "_b", "speaker", "confidence"))).alias("_s"))
    values = F.transform("_s", lambda s: s["confidence"])
    mean = F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), lambda x, y: (x + y) / 2)
    head = F.element_at("_s", 1)
    return packed.select(key, "part", head["_a"].alias("start_ms"), F.element_at("_s", -1)["_b"].alias("end_ms"), head["speaker"].alias("speaker"), mean.alias("confidence"), F.size("_s").alias("n"))


def overlap_groups(rows: DataFrame, key: str = "meeting") -> DataFrame:
    """Groups of rows that overlap the group's first row (not each other in turn); groups of one go.

    Rows without a start are groups of one and come first; after one without an end a group begins.
    """
    slim = rows.select(key, "seq", F.col("start_ms").cast("long").alias("_a"), F.coalesce("end_ms", "start_ms").cast("long").alias("_b"))
    none = slim.where("_a is null").groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_none"))
    each = greedy.began(slim.where("_a is not null"), key, "_a", "_b", ("seq",)).groupBy(key, "group").agg(F.count("*").alias("members"), F.min("seq").alias("first_seq")).where("members > 1")
    return each.join(none, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, (F.col("group") + F.coalesce("_none", F.lit(0))).cast("int").alias("g"), "members", "first_seq")


def split_long(rows: DataFrame, most: int) -> DataFrame:
    """Rows longer than ``most`` in the least number of equal parts."""
    length = F.col("end_ms") - F.col("start_ms")
    parts = F.greatest(F.ceil(length / most), F.lit(1)).cast("long")
    each = rows.withColumn("_n", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("start_ms") + F.floor(length * F.col("part") / F.col("_n"))
    end = F.col("start_ms") + F.floor(length * (F.col("part") + 1) / F.col("_n"))
    return each.withColumn("part_start", start).withColumn("part_end", end).drop("_n")


def runs(rows: DataFrame, above: Column, key: str = "stream", order: tuple[str, ...] = ("t_us", "seq")) -> DataFrame:
    """``speech``, ``run`` (number of the run) and ``in_run`` (place in it) for each row."""
    own = W.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("speech", above)
    marked = marked.withColumn("_new", F.coalesce((F.col("speech") != F.lag("speech").over(own)).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(own))
    return marked.withColumn("in_run", F.row_number().over(W.partitionBy(key, "run").orderBy(*order))).drop("_new")


def steady(rows: DataFrame, most: int, key: str = "meeting") -> DataFrame:
    """Per group: the longest gap between two segments of one speaker, and whether none exceeds ``most``."""
    after = F.lead("start_ms").over(W.partitionBy(key, "speaker").orderBy("start_ms", "seq"))
    return rows.select(key, (after - F.col("end_ms")).alias("_g")).groupBy(key).agg(F.max("_g").alias("longest"), F.coalesce(F.bool_and(F.col("_g") <= most), F.lit(True)).alias("steady"))
