"""Evaluation of recognised segments and words against a reference."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.intervals import best_overlap, labelled_spans, overlap_join, overlapping_pairs
from parley.session import ship


def cells(reference: DataFrame, hypothesis: DataFrame, *by: str) -> DataFrame:
    """Cells that are right, of the wrong speaker, missed and falsely found (10 ms each), per ``by``."""
    spans = labelled_spans(reference, hypothesis)
    n = F.col("b") - F.col("a")
    r, h = F.col("reference"), F.col("hypothesis")
    count = lambda hit: F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).cast("long")
    return spans.groupBy(*by).agg(count(r == h).alias("correct"), count(r != h).alias("confused"), count(r.isNotNull() & h.isNull()).alias("missed"), count(r.isNull() & h.isNotNull()).alias("false_alarm"))


def rates(counted: DataFrame) -> DataFrame:
    """Error rates over reference speech, and precision, recall, F1."""
    c = {x: F.col(x) for x in ("correct", "confused", "missed", "false_alarm")}
    speech = c["correct"] + c["confused"] + c["missed"]
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(c["correct"], c["correct"] + c["confused"] + c["false_alarm"]), share(c["correct"], speech)
    return counted.select("*", share(c["confused"] + c["missed"] + c["false_alarm"], speech).alias("der"), share(c["confused"], speech).alias("confusion_rate"), share(c["missed"], speech).alias("miss_rate"), share(c["false_alarm"], speech).alias("false_alarm_rate"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def confusion(reference: DataFrame, hypothesis: DataFrame, *by: str) -> DataFrame:
    """How often a recognised segment of one speaker overlaps most with a true one of another."""
    best = best_overlap(hypothesis, reference)
    keys = [F.col(f"l_{k}").alias(k) for k in by]
    return best.groupBy(*keys, F.col("r_speaker").alias("true_speaker"), F.col("l_speaker").alias("predicted_speaker")).agg(F.count("*").alias("n"))


def purity(matrix: DataFrame) -> DataFrame:
    """Per true speaker the share of its most frequent predicted speaker."""
    top = F.max(F.struct("n", "predicted_speaker"))
    return matrix.groupBy("true_speaker").agg(top.alias("t"), F.sum("n").alias("total")).select("true_speaker", F.col("t.predicted_speaker").alias("predicted_speaker"), (F.col("t.n") / F.col("total")).alias("purity"))


def coverage(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Per true speaker the share of its time that recognised segments cover, each segment once at most."""
    pairs = overlap_join(reference, hypothesis).groupBy(F.col("l_meeting").alias("meeting"), F.col("l_seq").alias("seq")).agg(F.sum("overlap").alias("o"))
    rows = reference.join(pairs, ["meeting", "seq"], "left").withColumn("d", F.col("end_ms") - F.col("start_ms"))
    own = rows.groupBy(F.col("speaker").alias("true_speaker")).agg(F.sum(F.least(F.coalesce("o", F.lit(0)), F.col("d"))).alias("covered"), F.sum("d").alias("total"))
    return own.select("true_speaker", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0).alias("coverage"))


def overlap_accuracy(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Overlapped time of both sides' pairs, and their ratio (it may exceed 1, as pairs are summed)."""
    a = overlapping_pairs(reference).agg(F.count("*").alias("true_pairs"), F.coalesce(F.sum("overlap"), F.lit(0)).alias("true_ms"))
    b = overlapping_pairs(hypothesis).agg(F.count("*").alias("found_pairs"), F.coalesce(F.sum("overlap"), F.lit(0)).alias("found_ms"))
    return a.crossJoin(b).withColumn("ratio", F.when(F.col("true_ms") > 0, F.col("found_ms") / F.col("true_ms")).otherwise(1.0))


def temporal_alignment(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Best overlap of each true segment, summed, over all true time."""
    best = overlap_join(reference, hypothesis).groupBy("l_meeting", "l_seq").agg(F.max("overlap").alias("o")).agg(F.coalesce(F.sum("o"), F.lit(0)).alias("aligned_ms"))
    total = reference.agg(F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")), F.lit(0)).alias("total_ms"))
    return best.crossJoin(total).withColumn("alignment", F.when(F.col("total_ms") > 0, F.col("aligned_ms") / F.col("total_ms")).otherwise(0.0))


def _bare(speaker: str) -> Column:
    return F.replace(F.col(speaker), F.lit("speaker_"), F.lit(""))


def matched(reference: DataFrame, hypothesis: DataFrame, least: float = 0.5) -> DataFrame:
    """Segments of each side with a partner: over ``least`` of the shorter one, same speaker.

    Speakers are the same if one's name, without ``speaker_``, is part of the other's.
    """
    pairs = overlap_join(reference, hypothesis).where((F.col("overlap") > least * F.least(F.col("l_end_ms") - F.col("l_start_ms"), F.col("r_end_ms") - F.col("r_start_ms"))) & (_bare("l_speaker").contains(_bare("r_speaker")) | _bare("r_speaker").contains(_bare("l_speaker"))))
    hit = pairs.agg(F.countDistinct("l_meeting", "l_seq").alias("true_matched"), F.countDistinct("r_meeting", "r_seq").alias("found_matched"))
    counts = reference.agg(F.count("*").alias("true_n")).crossJoin(hypothesis.agg(F.count("*").alias("found_n")))
    both = hit.crossJoin(counts)
    p, r = F.when(F.col("found_n") > 0, F.col("found_matched") / F.col("found_n")).otherwise(0.0), F.when(F.col("true_n") > 0, F.col("true_matched") / F.col("true_n")).otherwise(0.0)
    return both.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def error_level(rate: Column) -> Column:
    return F.when(rate < 0.05, "excellent").when(rate < 0.1, "good").when(rate < 0.2, "fair").otherwise("poor")


def overall_score(wer: Column, der: Column, rtf: Column, attribution: Column) -> Column:
    """0.4 words, 0.3 speakers, 0.2 speed, 0.1 attribution; each part and the sum from 0 to 100."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    return clamp(0.4 * clamp(100 - wer * 100) + 0.3 * clamp(100 - der * 100) + 0.2 * clamp((2 - rtf) * 50) + 0.1 * attribution * 100)


#: Bounds of the rules, by kind; what a rule reads and whether more or less is bad.
RULES = {
    "critical": (("wer", ">", 0.30, "far too many word errors"), ("der", ">", 0.3, "far too many speaker errors"), ("rtf", ">", 3.0, "far too slow")),
    "performance": (("rtf", ">", 1.5, "use a faster model"), ("memory_mb", ">", 2000.0, "use less memory"), ("latency_ms", ">", 3000.0, "cut the latency")),
    "accuracy": (("wer_moderate", ">", 0.10, "use a larger recognition model"), ("precision", "<", 0.8, "tune speaker clustering"), ("attribution", "<", 0.8, "align words with speakers")),
    "settings": (("miss_rate", ">", 0.2, "lower the speech threshold"), ("false_alarm_rate", ">", 0.2, "raise the speech threshold")),
}


def recommendations(**values: Column) -> Column:
    """What to do, by the rules whose value is given; ``wer`` up to its critical bound also counts as moderate."""
    if "wer" in values:
        values["wer_moderate"] = F.when(values["wer"] <= 0.30, values["wer"])
    hits = [F.when(values[name] > bound if way == ">" else values[name] < bound, F.lit(text)) for rules in RULES.values() for name, way, bound, text in rules if name in values]
    return F.array_compact(F.array(*hits))


def level(value: Column, bounds: tuple[float, float, float]) -> Column:
    """excellent, good, fair or poor by three rising bounds."""
    return F.when(value < bounds[0], "excellent").when(value < bounds[1], "good").when(value < bounds[2], "fair").otherwise("poor")


def validation_summary(der: Column, f1: Column, consistency: Column, rtf: Column, memory_mb: Column, target_der: float = 0.15, target_rtf: float = 1.5, least_consistency: float = 0.85) -> dict[str, Column]:
    """Levels, overall quality (0.5 speakers, 0.3 consistency, 0.2 speed), strengths, what to improve, and whether targets are met."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    good = ((der < 0.15, "accurate speakers"), (f1 > 0.85, "balanced precision and recall"), (consistency > 0.85, "consistent speakers"), (rtf < 1.0, "real time"), (memory_mb < 300, "little memory"))
    bad = ((der > 0.25, "speaker accuracy"), (f1 < 0.70, "precision and recall"), (consistency <= 0.85, "speaker consistency"), (rtf > 1.5, "speed"), (memory_mb > 500, "memory"))
    pick = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(x)) for t, x in tests]))
    return {
        "accuracy_level": level(der, (0.1, 0.2, 0.3)),
        "performance_level": level(rtf, (0.5, 1.0, 2.0)),
        "quality": clamp(0.5 * clamp(1.0 - der) + 0.3 * consistency + 0.2 * clamp(2.0 - rtf)),
        "strengths": pick(good),
        "improvements": pick(bad),
        "meets_targets": (der < target_der) & (rtf < target_rtf) & (consistency > least_consistency),
    }


def consistency(pure: DataFrame, covered: DataFrame) -> DataFrame:
    """Mean purity and coverage over the true speakers, and their mean: the consistency score."""
    both = pure.agg(F.coalesce(F.avg("purity"), F.lit(0.0)).alias("purity")).crossJoin(covered.agg(F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("coverage")))
    return both.withColumn("score", (F.col("purity") + F.col("coverage")) / 2)


def benchmark_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Of runs (ms, memory_mb, segments): times, memory, segments a second and a megabyte."""
    out = runs.groupBy(*by).agg(F.avg("ms").alias("mean_ms"), F.min("ms").alias("least_ms"), F.max("ms").alias("most_ms"), F.stddev_pop("ms").alias("deviation_ms"), F.avg("memory_mb").alias("mean_mb"), F.max("memory_mb").alias("peak_mb"), F.sum("segments").alias("_s"), F.avg("segments").alias("_m"))
    seconds = F.col("mean_ms") / 1000
    return out.withColumn("segments_a_second", F.when(seconds > 0, F.col("_s") / seconds).otherwise(0.0)).withColumn("segments_a_mb", F.when(F.col("mean_mb") > 0, F.col("_m") / F.col("mean_mb")).otherwise(0.0)).drop("_s", "_m")


def compared(runs: list[DataFrame], every: int = 100) -> DataFrame:
    """``meeting, i, j, samples, equal`` for each two runs: moments ``every`` ms apart up to their last end, and
    those at which both have the same speaker or none.

    The first segment that holds a moment counts; both its ends do. Spans in which no segment of any
    run begins or ends are counted as a whole, all runs at once, so rows grow with segments, not with time.
    """
    every_run = None
    for i, run in enumerate(runs):
        own = run.select("meeting", "seq", "speaker", "end_ms", F.lit(i).alias("run"), F.ceil(F.col("start_ms") / every).alias("a"), (F.floor(F.col("end_ms") / every) + 1).alias("b"))
        every_run = own if every_run is None else every_run.unionByName(own)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(len(runs)) for i in range(j)])
    ends = every_run.groupBy("meeting", "run").agg(F.max("end_ms").alias("end")).groupBy("meeting").agg(F.map_from_entries(F.collect_list(F.struct("run", "end"))).alias("_e"))
    last = F.greatest(F.try_element_at("_e", F.col("p.i")), F.try_element_at("_e", F.col("p.j")))
    total = ends.select("meeting", "_e", F.explode(pairs).alias("p")).select("meeting", "p.i", "p.j", F.ceil(last / every).alias("samples")).where("samples > 0")
    held = every_run.where("b > a").select("meeting", "seq", "speaker", "run", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
    points = held.select("meeting", F.explode(F.array("start_ms", "end_ms")).alias("start_ms")).distinct()
    spans = points.withColumn("end_ms", F.lead("start_ms").over(W.partitionBy("meeting").orderBy("start_ms"))).where("end_ms is not null")
    names = [F.col("l_meeting").alias("meeting"), F.col("l_start_ms").alias("a"), F.col("l_end_ms").alias("b")]
    each = overlap_join(spans, held, width=60_000 // every).groupBy(*names, "r_run").agg(F.min_by("r_speaker", "r_seq").alias("who"))
    labels = each.groupBy("meeting", "a", "b").agg(F.map_from_entries(F.collect_list(F.struct("r_run", "who"))).alias("_l"))
    unlike = labels.select("meeting", "a", "b", "_l", F.explode(pairs).alias("p")).where(~F.try_element_at("_l", F.col("p.i")).eqNullSafe(F.try_element_at("_l", F.col("p.j"))))
    cells = F.greatest(F.least("b", "samples") - F.col("a"), F.lit(0))
    differ = unlike.select("meeting", "p.i", "p.j", "a", "b").join(total, ["meeting", "i", "j"]).groupBy("meeting", "i", "j").agg(F.sum(cells).alias("d"))
    return total.join(differ, ["meeting", "i", "j"], "left").select("meeting", "i", "j", "samples", (F.col("samples") - F.coalesce("d", F.lit(0))).alias("equal"))


def sampled(a: DataFrame, b: DataFrame, every: int = 100) -> DataFrame:
    """``meeting, samples, equal`` of two sides (see ``compared``)."""
    return compared([a, b], every).select("meeting", "samples", "equal")


def agreement(runs: list[DataFrame], every: int = 100) -> DataFrame:
    """Per meeting the mean share of equal moments over all pairs of runs."""
    shares = compared(runs, every).select("meeting", (F.col("equal") / F.col("samples")).alias("share"))
    return shares.groupBy("meeting").agg(F.avg("share").alias("agreement"), F.count("*").alias("pairs"))


def single_speaker(found: DataFrame, expected: str, duration: DataFrame, key: str = "meeting") -> DataFrame:
    """Where one speaker should speak for ``expected_ms``: missed, surplus and wrong time over it, and the share with a fitting label.

    Labels that hold ``speaker`` are generic and count as right, for the share also ``unknown_speaker``.
    """
    length, who = F.col("end_ms") - F.col("start_ms"), F.col("speaker")
    fits = (who == expected) | who.contains("speaker")
    held = (who == expected) | who.startswith("speaker_") | (who == "unknown_speaker")
    sums = found.groupBy(key).agg(F.sum(length).alias("_t"), F.coalesce(F.sum(F.when(fits, length)), F.lit(0)).alias("_c"), F.coalesce(F.sum(F.when(held, length)), F.lit(0)).alias("_h"))
    e, t = F.col("expected_ms"), F.col("_t")
    out = duration.join(sums, key, "left")
    zero = F.lit(0)
    wrong = (F.greatest(e - t, zero) + F.greatest(t - e, zero) + t - F.col("_c")) / e
    return out.select(key, F.when(t.isNull(), 1.0).otherwise(wrong).alias("der"), F.coalesce(F.least(F.col("_h") / e, F.lit(1.0)), F.lit(0.0)).alias("attribution"))


def combined_error(wer: Column, der: Column, attribution: Column) -> Column:
    """0.6 words, 0.3 speakers, 0.1 attribution."""
    return 0.6 * wer + 0.3 * der + 0.1 * (1 - attribution)


def _places(words: list) -> dict:
    """Where each word stands, as the bits of a number."""
    out: dict = {}
    for j, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << j
    return out


def _row(match: int, up: int, down: int, full: int) -> tuple[int, int, int]:
    """The next row of an edit matrix, as bits: steps of +1 and of -1 to the right, and cells that are no
    dearer than the one before on the diagonal."""
    diagonal = (((match & up) + up) ^ up) | match | down
    rise, fall = down | ~(diagonal | up), diagonal & up
    rise, fall = (rise << 1 | 1) & full, fall << 1 & full
    return (fall | ~(diagonal | rise)) & full, rise & diagonal, diagonal & full


def _edits(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions of a cheapest edit script; ties prefer them in that order.

    Rows are numbers of a bit for each word. Only each so-manieth row is kept, about the square root of
    all; the walk back makes the rows between two kept ones again. So texts of 100,000 words need
    some 20 MB.
    """
    m, n = len(reference), len(hypothesis)
    stride, full, places = max(1, math.isqrt(m)), (1 << n) - 1, _places(hypothesis)
    up, down, kept = full, 0, []
    for i, w in enumerate(reference):
        if i % stride == 0:
            kept.append((up, down))
        up, down, _ = _row(places.get(w, 0), up, down, full)
    s = ins = dele = 0
    i, j, block, base = m, n, [], m
    while i and j:
        if i <= base:
            base = (i - 1) // stride * stride
            up, down = kept[base // stride]
            block = []
            for w in reference[base:i]:
                up, down, diagonal = _row(places.get(w, 0), up, down, full)
                block.append((up, diagonal))
        right, diagonal = block[i - base - 1]
        same = reference[i - 1] == hypothesis[j - 1]
        if same or not diagonal >> j - 1 & 1:
            s += not same
            i, j = i - 1, j - 1
        elif right >> j - 1 & 1:
            ins, j = ins + 1, j - 1
        else:
            dele, i = dele + 1, i - 1
    return s, ins + j, dele + i


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, a bit for each word of ``b``."""
    full, places = (1 << len(b)) - 1, _places(b)
    left = full
    for w in a:
        met = left & places.get(w, 0)
        left = (left + met | left - met) & full
    return len(b) - left.bit_count()


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("substitutions", "insertions", "deletions")]))
def edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Edit operations between two columns of word lists; null counts as empty."""
    return pd.DataFrame([_edits(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(reference, hypothesis, strict=True)], columns=["substitutions", "insertions", "deletions"])


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("substitutions", "insertions", "deletions")]))
def char_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Edit operations between the characters of two columns of texts; null counts as empty. Only one pair is held as lists."""
    return pd.DataFrame([_edits(list(a or ""), list(b or "")) for a, b in zip(reference, hypothesis, strict=True)], columns=["substitutions", "insertions", "deletions"])


@F.pandas_udf(T.LongType())
def common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words of the longest common subsequence of two columns of word lists."""
    return pd.Series([_common(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)], dtype="int64")


def word_errors(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``pairs`` with the edit counts and the error rate over the reference's words."""
    ship(pairs.sparkSession)
    return _rated(pairs.withColumn("_e", edits(F.col(reference), F.col(hypothesis))), F.size(reference), F.size(hypothesis))


def char_errors(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """The same for the characters of two columns of texts, without lists of them as columns."""
    ship(pairs.sparkSession)
    return _rated(pairs.withColumn("_e", char_edits(F.col(reference), F.col(hypothesis))), F.char_length(reference), F.char_length(hypothesis))


def _rated(edited: DataFrame, n: Column, m: Column) -> DataFrame:
    wrong = F.col("_e.substitutions") + F.col("_e.insertions") + F.col("_e.deletions")
    return edited.select(*[c for c in edited.columns if c != "_e"], "_e.substitutions", "_e.insertions", "_e.deletions", n.cast("long").alias("n_words_reference"), F.when(n > 0, wrong / n).otherwise(F.when(m > 0, 1.0).otherwise(0.0)).alias("wer"))


def corpus_errors(each: DataFrame, *by: str) -> DataFrame:
    """Edit counts and rates over all pairs of ``word_errors``, not the mean of their rates."""
    out = each.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("substitutions", "insertions", "deletions")], F.sum("n_words_reference").alias("n_reference"))
    wrong = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    rate = F.when(F.col("n_reference") > 0, wrong / F.col("n_reference")).otherwise(0.0)
    return out.withColumn("error_rate", rate).withColumn("accuracy", F.greatest(1 - F.col("error_rate"), F.lit(0.0)))


def speaker_errors(reference: DataFrame, hypothesis: DataFrame, key: str = "meeting") -> DataFrame:
    """Word errors of each true speaker: all its words on both sides (key, speaker, seq, words), aligned as one text.

    Speakers without reference words have no rate. ``n_words_reference`` is the weight of a speaker.
    """
    def joined(rows: DataFrame, name: str) -> DataFrame:
        own = rows.groupBy(key, "speaker").agg(F.array_sort(F.collect_list(F.struct("seq", "words"))).alias("w"))
        return own.select(key, "speaker", F.flatten(F.transform("w", lambda x: x["words"])).alias(name))

    both = joined(reference, "a").where(F.size("a") > 0).join(joined(hypothesis, "b"), [key, "speaker"], "left")
    return word_errors(both.withColumn("b", F.coalesce("b", F.array().cast("array<string>"))), "a", "b").drop("a", "b")


def attribution(words: DataFrame, truth: DataFrame, least: int) -> DataFrame:
    """Words (key, seq, pos, speaker, span) whose first true word that overlaps by more than ``least`` has their speaker, those that have not, and all."""
    pairs = overlap_join(words, truth).where(F.col("overlap") > least)
    first = pairs.groupBy("l_meeting", "l_seq", "l_pos", "l_speaker").agg(F.min_by("r_speaker", F.struct("r_seq", "r_pos")).alias("true_speaker"))
    right = first.agg(F.coalesce(F.sum((F.col("l_speaker") == F.col("true_speaker")).cast("long")), F.lit(0)).alias("correct"))
    both = right.crossJoin(words.agg(F.count("*").alias("total")))
    return both.select("correct", (F.col("total") - F.col("correct")).alias("incorrect"), "total", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0).alias("accuracy"))
