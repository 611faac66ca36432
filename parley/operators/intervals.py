"""Joins of timed rows. Each has an equality key (meeting and time bucket), so none is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Milliseconds of a time bucket; a few times the usual segment.
BUCKET = 60_000


def overlap(s1, e1, s2, e2) -> Column:
    """Shared length of two spans, at least 0."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def _side(rows: DataFrame, prefix: str, start: str, end: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    named = rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns], first.alias(f"_{prefix}f"), F.explode(F.sequence(first, F.greatest(first, last))).alias("_b"))
    return named


def overlap_join(left: DataFrame, right: DataFrame, key: str = "meeting", start: str = "start_ms", end: str = "end_ms", width: int = BUCKET) -> DataFrame:
    """Every pair of rows with one key whose spans overlap, once: ``l_*``, ``r_*`` and ``overlap``.

    Both sides are dealt out over the time buckets they touch; a pair counts in the first bucket
    that both touch. A meeting with very many segments is spread over its buckets.
    """
    a, b = _side(left, "l_", start, end, width), _side(right, "r_", start, end, width)
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (a["_b"] == b["_b"]) & (F.col(f"l_{start}") < F.col(f"r_{end}")) & (F.col(f"l_{end}") > F.col(f"r_{start}")) & (a["_b"] == F.greatest("_l_f", "_r_f"))
    joined = a.join(b, on)
    shared = overlap(F.col(f"l_{start}"), F.col(f"l_{end}"), F.col(f"r_{start}"), F.col(f"r_{end}"))
    return joined.select(*[c for c in a.columns + b.columns if not c.startswith("_")], shared.alias("overlap"))


def align(transcript: DataFrame, speakers: DataFrame, least: float = 0.5) -> DataFrame:
    """Speaker of each transcript segment (meeting, seq, text, start_ms, end_ms, confidence).

    Speaker segments that cover more than ``least`` of it count, largest first. None: speaker
    ``unknown_speaker`` and half the confidence. One: mean of both confidences. Several: the segment
    is split in proportion (see ``split``); ``part`` numbers the pieces.
    """
    pairs = overlap_join(transcript, speakers).where(F.col("overlap") > least * (F.col("l_end_ms") - F.col("l_start_ms")))
    lists = pairs.groupBy(F.col("l_meeting").alias("meeting"), F.col("l_seq").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("overlap", (-F.col("r_start_ms")).alias("n"), (-F.col("r_seq")).alias("k"), F.col("r_speaker").alias("speaker"), F.col("r_confidence").alias("confidence"))), asc=False).alias("found"))
    rows = transcript.join(lists, ["meeting", "seq"], "left").withColumn("found", F.coalesce("found", F.expr("array()").cast(lists.schema["found"].dataType)))
    piece = lambda s, e, who, text, conf, part: F.struct(s.alias("start_ms"), e.alias("end_ms"), who.alias("speaker"), text.alias("text"), conf.alias("overall"), part.alias("part"))
    s, e, t, c = (F.col(x) for x in ("start_ms", "end_ms", "text", "confidence"))
    one = F.element_at("found", 1)
    none = F.array(piece(s, e, F.lit("unknown_speaker"), t, c * 0.5, F.lit(0)))
    single = F.array(piece(s, e, one["speaker"], t, (c + one["confidence"]) / 2, F.lit(0)))
    pieces = F.when(F.size("found") == 0, none).when(F.size("found") == 1, single).otherwise(split(F.col("found"), s, e, t, c))
    return rows.select("meeting", "seq", F.explode(pieces).alias("p")).select("meeting", "seq", "p.*")


def split(found: Column, start: Column, end: Column, text: Column, confidence: Column) -> Column:
    """Pieces one after the other, as long as each speaker's overlap; all but the last get words by
    share, the last one the whole text; it stops once the end is reached."""
    from parley.functions.text import words

    ws = words(text)
    empty = F.expr("array()").cast("array<struct<start_ms:bigint,end_ms:bigint,speaker:string,text:string,overall:double,part:int>>")
    init = F.struct(start.alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        until = acc["at"] + x["overlap"]
        last = F.size(acc["out"]) == F.size(found) - 1
        n = F.round(F.size(ws) * x["overlap"] / (end - start)).cast("int")
        own = F.when(last, text).otherwise(F.array_join(F.slice(ws, 1, F.greatest(n, F.lit(0))), " "))
        made = F.struct(acc["at"].alias("start_ms"), F.least(until, end).alias("end_ms"), x["speaker"].alias("speaker"), own.alias("text"), ((confidence + x["confidence"]) / 2).alias("overall"), F.size(acc["out"]).alias("part"))
        return F.when(acc["at"] >= end, acc).otherwise(F.struct(until.alias("at"), F.concat(acc["out"], F.array(made)).alias("out")))

    return F.aggregate(found, init, step, lambda acc: acc["out"])


def best_overlap(rows: DataFrame, others: DataFrame, over: int = 0) -> DataFrame:
    """For each row (meeting, seq) the other row with the largest overlap above ``over``; ties: first."""
    pairs = overlap_join(rows, others).where(F.col("overlap") > over)
    rank = F.row_number().over(W.partitionBy("l_meeting", "l_seq").orderBy(F.desc("overlap"), "r_seq"))
    return pairs.withColumn("_k", rank).where("_k = 1").drop("_k")


def overlapping_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of one table's rows, first seq below the second."""
    return overlap_join(rows, rows).where("l_seq < r_seq")


def conflicts(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that overlap any other row of the meeting (semi join)."""
    hit = overlap_join(rows, others).where("l_seq <> r_seq").select(F.col("l_meeting").alias("meeting"), F.col("l_seq").alias("seq")).distinct()
    return rows.join(hit, ["meeting", "seq"], "left_semi")


def labelled_spans(reference: DataFrame, hypothesis: DataFrame, cell_ms: int = 10) -> DataFrame:
    """Elementary spans in cells with the label of each side: key, a, b (cells), reference, hypothesis.

    Where a side's segments overlap, the later seq counts. Equal to labelling every cell, but rows
    grow with the number of segments, not with their length. Cells that neither side labels are left out.
    """
    cells = lambda d: d.select("meeting", "seq", "speaker", F.floor(F.col("start_ms") / cell_ms).alias("start_ms"), F.floor(F.col("end_ms") / cell_ms).alias("end_ms")).where("end_ms > start_ms")
    ref, hyp = cells(reference), cells(hypothesis)
    both = ref.union(hyp)
    points = both.select("meeting", F.explode(F.array("start_ms", "end_ms")).alias("start_ms")).distinct()
    spans = points.withColumn("end_ms", F.lead("start_ms").over(W.partitionBy("meeting").orderBy("start_ms"))).where("end_ms is not null")

    def label(side: DataFrame, name: str) -> DataFrame:
        pairs = overlap_join(spans, side, width=BUCKET // cell_ms)
        return pairs.groupBy(F.col("l_meeting").alias("meeting"), F.col("l_start_ms").alias("a"), F.col("l_end_ms").alias("b")).agg(F.max_by("r_speaker", "r_seq").alias(name))

    return label(ref, "reference").join(label(hyp, "hypothesis"), ["meeting", "a", "b"], "full_outer")


def at_time(rows: DataFrame, time_ms: int) -> DataFrame:
    """The first row of each meeting that holds a moment."""
    return rows.where(F.lit(time_ms).between(F.col("start_ms"), F.col("end_ms"))).groupBy("meeting").agg(F.min("seq").alias("seq"))


def within(rows: DataFrame, start: int, end: int) -> DataFrame:
    return rows.where((F.col("start_ms") < end) & (F.col("end_ms") > start))


def merge(transcript: DataFrame, speakers: DataFrame, least: float = 0.5) -> DataFrame:
    """``align``, and what it leaves out: meetings that only one side has.

    Without speaker segments a transcript keeps its own speaker and confidence; without a transcript
    a speaker segment has an empty text. ``part`` numbers the pieces of a segment.
    """
    both = transcript.join(speakers.select("meeting").distinct(), "meeting", "left_semi")
    only = transcript.join(speakers.select("meeting").distinct(), "meeting", "left_anti")
    silent = speakers.join(transcript.select("meeting").distinct(), "meeting", "left_anti")
    named = lambda d, text: d.select("meeting", "seq", "start_ms", "end_ms", "speaker", text.alias("text"), F.col("confidence").alias("overall"), F.lit(0).alias("part"))
    return align(both, speakers, least).unionByName(named(only, F.col("text"))).unionByName(named(silent, F.lit("")))


def majority(found: DataFrame, truth: DataFrame, least: int) -> DataFrame:
    """Per meeting and found speaker: the true speaker that most of its segments overlap best (ties:
    first name), how many do, and how many segments it has. Overlaps below ``least`` do not count."""
    votes = best_overlap(found, truth, least - 1).groupBy(F.col("l_meeting").alias("meeting"), F.col("l_speaker").alias("speaker"), F.col("r_speaker").alias("true_speaker")).agg(F.count("*").alias("n"))
    best = votes.groupBy("meeting", "speaker").agg(F.min(F.struct((-F.col("n")).alias("n"), "true_speaker")).alias("b"))
    total = found.groupBy("meeting", "speaker").agg(F.count("*").alias("segments"))
    return total.join(best, ["meeting", "speaker"], "left").select("meeting", "speaker", F.col("b.true_speaker").alias("true_speaker"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("correct"), "segments")


def same_timing(s1: Column, e1: Column, s2: Column, e2: Column, tolerance: int) -> Column:
    """Whether both ends are within ``tolerance``."""
    return (F.abs(s1 - s2) <= tolerance) & (F.abs(e1 - e2) <= tolerance)
