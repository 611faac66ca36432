"""Boundaries and speech segments from energy frames of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import windows

ORDER = ("t_us", "seq")


def trailing(frames: DataFrame, silence: float, key: str = "stream") -> DataFrame:
    """Mean and variance over the last 10 frames, silent frames of the last 8, runs of speech and silence."""
    own = W.partitionBy(key).orderBy(*ORDER)
    ten, eight = own.rowsBetween(-9, 0), own.rowsBetween(-7, 0)
    out = windows.runs(frames, F.col("energy") > silence, key, ORDER)
    return out.select("*", F.avg("energy").over(ten).alias("mean10"), F.var_pop("energy").over(ten).alias("var10"), F.count("*").over(ten).alias("n10"), F.sum((F.col("energy") <= silence).cast("long")).over(eight).alias("silent8"))


def natural(trailed: DataFrame, least: float = 0.05, most: float = 0.5) -> Column:
    """Whether the last 10 frames vary as speech does."""
    return (F.col("n10") >= 10) & F.col("var10").between(least, most)


def segments(frames: DataFrame, over: float, least_us: int, key: str = "stream") -> DataFrame:
    """Runs of frames above ``over`` that last ``least_us`` or longer; a run still open at the end closes there.

    Confidence is the pairwise running mean of the energies in order.
    """
    marked = windows.runs(frames, F.col("energy") > over, key, ORDER).where("speech")
    packed = marked.groupBy(key, "run").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("t_us", "seq", "energy"))).alias("_e"))
    values = F.transform("_e", lambda e: e["energy"])
    mean = F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), lambda a, x: (a + x) / 2)
    return packed.where(F.col("end_us") - F.col("start_us") >= least_us).select(key, "run", "start_us", "end_us", "n", mean.alias("confidence"))


def sessions(frames: DataFrame, gap_us: int, key: str = "stream") -> DataFrame:
    """Sessions end where the next frame is ``gap_us`` or more away."""
    own = W.partitionBy(key).orderBy(*ORDER)
    fresh = F.coalesce((F.col("t_us") - F.lag("t_us").over(own) >= gap_us).cast("int"), F.lit(1))
    marked = frames.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(own))
    return marked.groupBy(key, "session").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("n"))


def throttled(frames: DataFrame, every: int, key: str = "stream") -> DataFrame:
    """One frame of each ``every``, the first one first."""
    return frames.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*ORDER))).where((F.col("_k") - 1) % every == 0).drop("_k")


def trend(frames: DataFrame, span: int, growth: float, key: str = "stream") -> DataFrame:
    """Per stream: peak, mean, last minus first, and how often ``span`` frames on is ``growth`` higher."""
    later = F.lead("energy", span - 1).over(W.partitionBy(key).orderBy(*ORDER))
    marked = frames.withColumn("_up", F.coalesce((later - F.col("energy") > growth).cast("long"), F.lit(0)))
    at = F.struct("t_us", "seq")
    return marked.groupBy(key).agg(F.max("energy").alias("peak"), F.avg("energy").alias("mean"), (F.max_by("energy", at) - F.min_by("energy", at)).alias("change"), F.sum("_up").alias("growing"))


def windowed(frames: DataFrame, over: float, length_us: int, step_us: int, least_us: int, frame_us: int, slack_us: int, key: str = "stream") -> DataFrame:
    """Speech within windows of ``length_us`` every ``step_us``, segments of overlapping windows merged.

    In each window a run of frames above ``over`` is a segment, up to the first frame after it (or one
    frame on, where the run goes to the window's end); its confidence is that frame's energy, at
    most 1, or 0.8 at the window's end. Short ones go. Segments at most ``slack_us`` apart merge.
    """
    first, last = F.floor((F.col("t_us") - length_us) / step_us) + 1, F.floor(F.col("t_us") / step_us)
    dealt = frames.select(key, "seq", "t_us", "energy", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("window"))
    own = W.partitionBy(key, "window").orderBy(*ORDER)
    marked = dealt.withColumn("_loud", F.col("energy") > over).withColumn("_next", F.lead("t_us").over(own)).withColumn("_after", F.lead("energy").over(own))
    marked = marked.withColumn("_new", F.coalesce((F.col("_loud") != F.lag("_loud").over(own)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(own))
    runs = marked.where("_loud").groupBy(key, "window", "_run").agg(F.min("t_us").alias("start_ms"), F.max_by(F.struct(F.coalesce("_next", F.col("t_us") + frame_us).alias("end"), F.coalesce(F.least("_after", F.lit(1.0)), F.lit(0.8)).alias("c")), F.struct("t_us", "seq")).alias("_e"))
    parts = runs.select(key, "window", "start_ms", F.col("_e.end").alias("end_ms"), F.col("_e.c").alias("confidence"), F.col("window").alias("seq")).where(F.col("end_ms") - F.col("start_ms") >= least_us)
    out = windows.merge_islands(parts, slack_us, key)
    return out.select(key, "island", F.col("start_ms").alias("start_us"), F.col("end_ms").alias("end_us"), "n", "confidence")


def peaks(frames: DataFrame, span_us: int, key: str = "stream") -> DataFrame:
    """``frames`` with the highest energy of the last ``span_us`` (its start left out)."""
    near = W.partitionBy(key).orderBy("t_us").rangeBetween(1 - span_us, 0)
    return frames.withColumn("peak", F.max("energy").over(near))


def activity(events: DataFrame, key: str = "meeting") -> DataFrame:
    """Per speaker its latest event (t, active), and per group who speaks now: the last to begin that has not stopped since."""
    at = F.struct("t", "seq")
    each = events.groupBy(key, "speaker").agg(F.max_by("active", at).alias("active"), F.max("t").alias("last"))
    begun = events.where("active").groupBy(key).agg(F.max_by("speaker", at).alias("_now"))
    return each.join(begun, key, "left").withColumn("current", F.coalesce(F.col("active") & (F.col("speaker") == F.col("_now")), F.lit(False))).drop("_now")


def real_time(processed_s: Column, played_s: Column, least: float = 0.95) -> tuple[Column, Column]:
    """Factor of processed over played time (0 without any), and whether it keeps up."""
    factor = F.when(played_s > 0, processed_s / played_s).otherwise(0.0)
    return factor, factor >= least


def buffer_stats(consumers: DataFrame, written: Column, capacity: int) -> DataFrame:
    """Readers of a buffer (position): how many, their mean lag behind ``written``, and how full it is."""
    lag = F.greatest(written - F.col("position"), F.lit(0))
    return consumers.agg(F.count("*").alias("consumers"), F.avg(lag).alias("mean_lag"), F.max(F.least(written, F.lit(capacity)) / capacity).alias("utilization"))
