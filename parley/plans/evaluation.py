"""Queries that score recognised segments against the true ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import intervals as I
from parley.operators import metrics as E
from parley.operators import windows as N
from parley.operators.intervals import labelled_spans
from parley.plans import texts, views
from parley.plans.registry import query
from parley.plans.texts import PAIRS
from parley.plans.timeline import MEET, OVERLAP, WORDS_SQL, pieces_sql
from parley.plans.views import PREDICTED, SEGMENTS, SQL_WORDS

#: The common table of recognised segments without those it builds on.
PREDICTED_ONLY = PREDICTED.removeprefix(SEGMENTS).lstrip(", \n")

GRID = """
gr as (select meeting, cell, arg_max(speaker, seq) as r from (select meeting, seq, speaker, unnest(range(start_ms // 10, end_ms // 10)) as cell from segments) group by 1, 2),
gh as (select meeting, cell, arg_max(speaker, seq) as h from (select meeting, seq, speaker, unnest(range(start_ms // 10, end_ms // 10)) as cell from predicted) group by 1, 2),
grid as (select meeting, cell, r, h from gr full outer join gh using (meeting, cell))"""
COUNTS = "count(*) filter (where r = h) as correct, count(*) filter (where r <> h) as confused, count(*) filter (where h is null) as missed, count(*) filter (where r is null) as false_alarm"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = views.segments(spark, sf_dir)
    return own, views.predicted(own)


@query(f"with {PREDICTED}, {GRID} select meeting, coalesce(r, '-') as reference, coalesce(h, '-') as hypothesis, count(*) as cells from grid group by 1, 2, 3")
def der_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = labelled_spans(*_sides(spark, sf_dir))
    return spans.groupBy("meeting", F.coalesce("reference", F.lit("-")).alias("reference"), F.coalesce("hypothesis", F.lit("-")).alias("hypothesis")).agg(F.sum(F.col("b") - F.col("a")).alias("cells"))


_RATES = """round((confused + missed + false_alarm) / (correct + confused + missed), 6) as der, round(correct / (correct + confused + false_alarm), 6) as precision, round(correct / (correct + confused + missed), 6) as recall"""


@query(f"with {PREDICTED}, {GRID}, c as (select {COUNTS} from grid) select *, {_RATES} from c")
def der_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.rates(E.cells(*_sides(spark, sf_dir)))
    return out.select("correct", "confused", "missed", "false_alarm", *[F.round(c, 6).alias(c) for c in ("der", "precision", "recall")])


@query(f"""with {PREDICTED}, {GRID}, c as (select meeting, {COUNTS} from grid group by 1), s as (select meeting, case when correct + confused + missed > 0 then (confused + missed + false_alarm) / (correct + confused + missed) else 0 end as der from c),
l as (select *, case when der < 0.05 then 'excellent' when der < 0.1 then 'good' when der < 0.2 then 'fair' else 'poor' end as level from s)
select level, count(*) as meetings, round(avg(der), 6) as mean_der, arg_min(meeting, (round(der, 9), meeting)) as best, arg_max(meeting, (round(der, 9), meeting)) as worst from l group by 1""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = E.rates(E.cells(*_sides(spark, sf_dir), "meeting")).select("meeting", "der", E.error_level(F.col("der")).alias("level"))
    key = F.struct(F.round("der", 9), "meeting")
    return each.groupBy("level").agg(F.count("*").alias("meetings"), F.round(F.avg("der"), 6).alias("mean_der"), F.min_by("meeting", key).alias("best"), F.max_by("meeting", key).alias("worst"))


_BEST = f"best as (select a.meeting, a.speaker as predicted_speaker, b.speaker as true_speaker, row_number() over (partition by a.meeting, a.seq order by {OVERLAP} desc, b.seq) as k from predicted a join segments b on {MEET})"
_MATRIX = f"{_BEST}, matrix as (select true_speaker, predicted_speaker, count(*) as n from best where k = 1 group by 1, 2)"


@query(f"with {PREDICTED}, {_MATRIX} select * from matrix")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(*_sides(spark, sf_dir))


@query(f"""with {PREDICTED}, {_MATRIX}, p as (select true_speaker, max(n) / sum(n) as purity from matrix group by 1),
o as (select a.meeting, a.seq, sum({OVERLAP}) as o from segments a join predicted b on {MEET} group by 1, 2),
c as (select speaker as true_speaker, sum(least(coalesce(o, 0), end_ms - start_ms)) / sum(end_ms - start_ms) as coverage from segments left join o using (meeting, seq) group by 1)
select true_speaker, round(purity, 6) as purity, round(coverage, 6) as coverage from p join c using (true_speaker)""")
def purity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _sides(spark, sf_dir)
    both = E.purity(E.confusion(own, found)).join(E.coverage(own, found), "true_speaker")
    return both.select("true_speaker", F.round("purity", 6).alias("purity"), F.round("coverage", 6).alias("coverage"))


@query(f"""with {PREDICTED}, a as (select count(*) as true_pairs, coalesce(sum({OVERLAP}), 0)::bigint as true_ms from segments a join segments b on {MEET} and a.seq < b.seq),
f as (select count(*) as found_pairs, coalesce(sum({OVERLAP}), 0)::bigint as found_ms from predicted a join predicted b on {MEET} and a.seq < b.seq)
select *, round(found_ms / true_ms, 6) as ratio from a, f""")
def overlap_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overlap_accuracy(*_sides(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query(f"""with {PREDICTED}, o as (select max({OVERLAP}) as o from segments a join predicted b on {MEET} group by a.meeting, a.seq), t as (select sum(end_ms - start_ms)::bigint as total_ms from segments)
select sum(o)::bigint as aligned_ms, any_value(total_ms) as total_ms, round(sum(o) / any_value(total_ms), 6) as alignment from o, t""")
def temporal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.temporal_alignment(*_sides(spark, sf_dir)).withColumn("alignment", F.round("alignment", 6))


@query(f"""with {PREDICTED}, p as (select a.meeting, a.seq as s, b.seq as q from segments a join predicted b on {MEET} where {OVERLAP} > 0.5 * least(a.end_ms - a.start_ms, b.end_ms - b.start_ms) and (contains(a.speaker, replace('speaker_' || b.speaker, 'speaker_', '')) or contains(replace('speaker_' || b.speaker, 'speaker_', ''), a.speaker))),
c as (select count(distinct (meeting, s)) as true_matched, count(distinct (meeting, q)) as found_matched from p), n as (select count(*) as true_n from segments), m as (select count(*) as found_n from predicted)
select *, round(found_matched / found_n, 6) as precision, round(true_matched / true_n, 6) as recall, round(2.0 * (found_matched / found_n) * (true_matched / true_n) / (found_matched / found_n + true_matched / true_n), 6) as f1 from c, n, m""")
def segment_match_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _sides(spark, sf_dir)
    out = E.matched(own, found.withColumn("speaker", F.concat(F.lit("speaker_"), "speaker")))
    return out.select("true_matched", "found_matched", "true_n", "found_n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""with {PREDICTED}, {GRID}, c as (select meeting, count(*) as cells, count(*) filter (where r is not distinct from h) as same from grid group by 1)
select round(avg(same / cells), 6) as agreement, count(*) as meetings from c""")
def run_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = labelled_spans(*_sides(spark, sf_dir))
    n = F.col("b") - F.col("a")
    each = spans.groupBy("meeting").agg(F.sum(n).alias("cells"), F.coalesce(F.sum(F.when(F.col("reference").eqNullSafe(F.col("hypothesis")), n)), F.lit(0)).alias("same"))
    return each.agg(F.round(F.avg(F.col("same") / F.col("cells")), 6).alias("agreement"), F.count("*").alias("meetings"))


_APPROXIMATE = "w0 as (select least(avg(approximate), 1) as wer from (select case when len(a) > 0 then (abs(len(a) - len(b)) + len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]))) / len(a) else 0 end as approximate from wp))"


@query(f"""with {PAIRS}, {PREDICTED_ONLY}, {GRID}, {_APPROXIMATE}, t0 as (select (select sum(end_ms - start_ms) from predicted) / (select sum(end_ms - start_ms) from segments) as rtf),
c as (select {COUNTS} from grid), s as (select (confused + missed + false_alarm) / (correct + confused + missed) as der, correct / (correct + confused + missed) as attribution, wer, rtf from c, w0, t0)
select round(0.4 * greatest(0, 100 - wer * 100) + 0.3 * greatest(0, least(100, 100 - der * 100)) + 0.2 * least(100, greatest(0, (2 - rtf) * 50)) + 0.1 * attribution * 100, 6) as score, case when der < 0.05 then 'excellent' when der < 0.1 then 'good' when der < 0.2 then 'fair' else 'poor' end as level,
array_to_string(list_filter([case when wer > 0.3 then 'far too many word errors' end, case when der > 0.3 then 'far too many speaker errors' end, case when rtf > 3 then 'far too slow' end, case when rtf > 1.5 then 'use a faster model' end, case when wer > 0.1 and wer <= 0.3 then 'use a larger recognition model' end], lambda x: x is not null), '; ') as advice from s""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by the approximate error rate of turns against the turn before, speed by recognised over true time."""
    own, found = _sides(spark, sf_dir)
    out = E.rates(E.cells(own, found))
    lists = texts._lists(spark, sf_dir)
    wer = lists.agg(F.least(F.avg(X.positional_error_rate(F.col("a"), F.col("b"))), F.lit(1.0)).alias("wer"))
    length = lambda rows, name: rows.agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(name))
    out = out.crossJoin(wer).crossJoin(length(own, "_o")).crossJoin(length(found, "_f")).withColumn("rtf", F.col("_f") / F.col("_o"))
    score = E.overall_score(F.col("wer"), F.col("der"), F.col("rtf"), F.col("recall"))
    advice = E.recommendations(wer=F.col("wer"), der=F.col("der"), rtf=F.col("rtf"))
    return out.select(F.round(score, 6).alias("score"), E.error_level(F.col("der")).alias("level"), F.array_join(advice, "; ").alias("advice"))


@query(f"""with {PREDICTED}, t as (select meeting, unnest(range(0, max(greatest(s.end_ms, p.end_ms)), 100)) as t from segments s join predicted p using (meeting, seq) group by meeting),
a as (select t.meeting, t.t, (select arg_min(speaker, seq) from segments s where s.meeting = t.meeting and t.t between s.start_ms and s.end_ms) as r, (select arg_min(speaker, seq) from predicted p where p.meeting = t.meeting and t.t between p.start_ms and p.end_ms) as h from t)
select meeting, count(*) as samples, count(*) filter (where r is not distinct from h) as equal from a group by 1""")
def sampled_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sampled(*_sides(spark, sf_dir))


@query(f"""with {PREDICTED}, {_MATRIX}, p as (select true_speaker, max(n) / sum(n) as purity from matrix group by 1),
o as (select a.meeting, a.seq, sum({OVERLAP}) as o from segments a join predicted b on {MEET} group by 1, 2),
c as (select speaker as true_speaker, sum(least(coalesce(o, 0), end_ms - start_ms)) / sum(end_ms - start_ms) as coverage from segments left join o using (meeting, seq) group by 1)
select round((select avg(purity) from p), 6) as purity, round((select avg(coverage) from c), 6) as coverage, round(((select avg(purity) from p) + (select avg(coverage) from c)) / 2, 6) as score""")
def speaker_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _sides(spark, sf_dir)
    out = E.consistency(E.purity(E.confusion(own, found)), E.coverage(own, found))
    return out.select(*[F.round(c, 6).alias(c) for c in ("purity", "coverage", "score")])


_EACH = """e as (select meeting, case when s > 0 then (confused + missed + false_alarm) / s else 0 end as der, case when correct + confused + false_alarm > 0 then correct / (correct + confused + false_alarm) else 0 end as p, case when s > 0 then correct / s else 0 end as r,
case when s > 0 then missed / s else 0 end as miss, case when s > 0 then false_alarm / s else 0 end as fa, (meeting % 40) / 10.0::double as rtf, (100 + meeting * 37 % 600)::double as mb, (meeting % 45) / 100.0::double as wer from (select *, correct + confused + missed as s from c))"""


def _each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of each meeting, with figures of speed, memory and words made of its number."""
    n = F.col("meeting")
    return E.rates(E.cells(*_sides(spark, sf_dir), "meeting")).select("*", ((n % 40) / 10.0).alias("rtf"), (100 + n * 37 % 600).cast("double").alias("mb"), ((n % 45) / 100.0).alias("wer"))


@query(f"""with {PREDICTED}, {GRID}, c as (select meeting, {COUNTS} from grid group by 1), {_EACH}, f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from e)
select meeting, case when der < 0.1 then 'excellent' when der < 0.2 then 'good' when der < 0.3 then 'fair' else 'poor' end as accuracy_level, case when rtf < 0.5 then 'excellent' when rtf < 1 then 'good' when rtf < 2 then 'fair' else 'poor' end as performance_level,
round(least(1, greatest(0, 0.5 * least(1, greatest(0, 1 - der)) + 0.3 * r + 0.2 * least(1, greatest(0, 2 - rtf)))), 6) as quality,
array_to_string(list_filter([case when der < 0.15 then 'accurate speakers' end, case when f1 > 0.85 then 'balanced precision and recall' end, case when r > 0.85 then 'consistent speakers' end, case when rtf < 1 then 'real time' end, case when mb < 300 then 'little memory' end], lambda x: x is not null), '; ') as strengths,
array_to_string(list_filter([case when der > 0.25 then 'speaker accuracy' end, case when f1 < 0.7 then 'precision and recall' end, case when r <= 0.85 then 'speaker consistency' end, case when rtf > 1.5 then 'speed' end, case when mb > 500 then 'memory' end], lambda x: x is not null), '; ') as improvements,
der < 0.15 and rtf < 1.5 and r > 0.85 as meets_targets from f""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = E.validation_summary(c("der"), c("f1"), c("recall"), c("rtf"), c("mb"))
    own = {k: F.array_join(v, "; ") if k in ("strengths", "improvements") else F.round(v, 6) if k == "quality" else v for k, v in out.items()}
    return _each(spark, sf_dir).select("meeting", *[v.alias(k) for k, v in own.items()])


@query(f"""with {PREDICTED}, {GRID}, c as (select meeting, {COUNTS} from grid group by 1), {_EACH}
select meeting, array_to_string(list_filter([case when wer > 0.3 then 'far too many word errors' end, case when der > 0.3 then 'far too many speaker errors' end, case when rtf > 3 then 'far too slow' end, case when rtf > 1.5 then 'use a faster model' end, case when mb * 5 > 2000 then 'use less memory' end, case when mb * 10 > 3000 then 'cut the latency' end,
case when wer > 0.1 and wer <= 0.3 then 'use a larger recognition model' end, case when p < 0.8 then 'tune speaker clustering' end, case when r < 0.8 then 'align words with speakers' end, case when miss > 0.2 then 'lower the speech threshold' end, case when fa > 0.2 then 'raise the speech threshold' end], lambda x: x is not null), '; ') as advice from e""")
def recommendation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = E.recommendations(wer=c("wer"), der=c("der"), rtf=c("rtf"), memory_mb=c("mb") * 5, latency_ms=c("mb") * 10, precision=c("precision"), attribution=c("recall"), miss_rate=c("miss_rate"), false_alarm_rate=c("false_alarm_rate"))
    return _each(spark, sf_dir).select("meeting", F.array_join(out, "; ").alias("advice"))


@query("""with r as (select event_type, value as ms, value / 3 + 1 as mb, event_id % 50 as n from events)
select event_type, round(avg(ms), 6) as mean_ms, round(min(ms), 6) as least_ms, round(max(ms), 6) as most_ms, round(stddev_pop(ms), 6) as deviation_ms, round(avg(mb), 6) as mean_mb, round(max(mb), 6) as peak_mb, round(sum(n) / (avg(ms) / 1000), 4) as segments_a_second, round(avg(n) / avg(mb), 6) as segments_a_mb from r group by 1""")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.session import table

    runs = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms"), (F.col("value") / 3 + 1).alias("memory_mb"), (F.col("event_id") % 50).alias("segments"))
    out = E.benchmark_summary(runs, "event_type")
    return out.select("event_type", *[F.round(c, 4 if c == "segments_a_second" else 6).alias(c) for c in out.columns if c != "event_type"])


def _sql_sampled(a: str, b: str) -> str:
    at = lambda t: f"(select arg_min(speaker, seq) from {t} s where s.meeting = t.meeting and t.t between s.start_ms and s.end_ms)"
    return f"select meeting, count(*) filter (where {at(a)} is not distinct from {at(b)}) / count(*) as share from (select meeting, unnest(range(0, max(end_ms), 100)) as t from (select meeting, end_ms from {a} union all select meeting, end_ms from {b}) group by 1) t group by 1"


@query(f"""with {PREDICTED}, third as (select meeting, seq, speaker, start_ms + 700 as start_ms, end_ms + 400 as end_ms from segments),
p as ({_sql_sampled("segments", "predicted")} union all {_sql_sampled("segments", "third")} union all {_sql_sampled("predicted", "third")}) select meeting, round(avg(share), 6) as agreement, count(*) as pairs from p group by 1""")
def runs_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _sides(spark, sf_dir)
    third = own.withColumn("start_ms", F.col("start_ms") + 700).withColumn("end_ms", F.col("end_ms") + 400)
    return E.agreement([own, found, third]).withColumn("agreement", F.round("agreement", 6))


@query(f"""with {PREDICTED}, d as (select meeting, max(end_ms) as e from segments group by 1), s as (select meeting, sum(end_ms - start_ms) as t, coalesce(sum(end_ms - start_ms) filter (where speaker = 'user'), 0) as c from predicted group by 1),
m as (select meeting, (greatest(e - t, 0) + greatest(t - e, 0) + t - c) / e as der, least(c / e, 1) as attribution from d join s using (meeting) where e > 0)
select meeting, round(der, 6) as der, round(attribution, 6) as attribution, round(0.6 * 0.25 + 0.3 * der + 0.1 * (1 - attribution), 6) as combined from m""")
def combined_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _sides(spark, sf_dir)
    duration = own.groupBy("meeting").agg(F.max("end_ms").alias("expected_ms")).where("expected_ms > 0")
    out = E.single_speaker(found, "user", duration)
    total = E.combined_error(F.lit(0.25), F.col("der"), F.col("attribution"))
    return out.select("meeting", F.round("der", 6).alias("der"), F.round("attribution", 6).alias("attribution"), F.round(total, 6).alias("combined"))


@query(f"""with {PREDICTED}, v as (select a.meeting, a.speaker, b.speaker as t, row_number() over (partition by a.meeting, a.seq order by {OVERLAP} desc, b.seq) as k from predicted a join segments b on {MEET} where {OVERLAP} >= 200),
n as (select meeting, speaker, t, count(*) as n from v where k = 1 group by 1, 2, 3), b as (select meeting, speaker, arg_min(t, (-n, t)) as true_speaker, max(n) as correct from n group by 1, 2)
select meeting, speaker, true_speaker, coalesce(correct, 0) as correct, segments from (select meeting, speaker, count(*) as segments from predicted group by 1, 2) left join b using (meeting, speaker)""")
def majority_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _sides(spark, sf_dir)
    return I.majority(found, own, 200)


@query(f"""with {PREDICTED}, tr as (select * from segments where meeting % 3 <> 0), sp as (select * from predicted where meeting % 3 <> 1),
tb as (select * from tr where meeting % 3 = 2), {pieces_sql("tb", "sp")}
select meeting, seq, part, speaker, md5(text) as digest, round(overall, 6) as overall from pieces
union all select meeting, seq, 0, speaker, md5(text), confidence from tr where meeting % 3 = 1 union all select meeting, seq, 0, speaker, md5(''), confidence from sp where meeting % 3 = 0""")
def merge_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _sides(spark, sf_dir)
    out = I.merge(own.where("meeting % 3 <> 0"), found.where("meeting % 3 <> 1"))
    return out.select("meeting", "seq", F.col("part").cast("long").alias("part"), "speaker", F.md5("text").alias("digest"), F.round("overall", 6).alias("overall"))


@query(f"""with {SEGMENTS}, w as (select meeting, (50 + (strlen(word) * 7 + pos) % 50) / 100.0::double as c from (select meeting, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from (select meeting, {SQL_WORDS.format('text')} as ws from segments)))
select meeting, round(avg(c), 6) as confidence, count(*) as words from w group by 1""")
def transcript_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of the words of each meeting."""
    words = views.segments(spark, sf_dir).select("meeting", F.posexplode(X.words(F.col("text"))).alias("pos", "word"))
    each = words.withColumn("c", (50 + (F.octet_length("word") * 7 + F.col("pos")) % 50) / 100.0)
    return each.groupBy("meeting").agg(F.round(F.avg("c"), 6).alias("confidence"), F.count("*").alias("words"))


@query(f"""with {PREDICTED}, {WORDS_SQL}, hw as (select meeting, seq, pos, p.speaker, w.start_ms, w.end_ms from words w join predicted p using (meeting, seq)),
m as (select a.meeting, a.seq, a.pos, a.speaker, arg_min(b.speaker, (b.seq, b.pos)) as t from hw a join words b on {MEET} where {OVERLAP} > 200 group by 1, 2, 3, 4)
select (select count(*) from m where speaker = t) as correct, (select count(*) from hw) - (select count(*) from m where speaker = t) as incorrect, (select count(*) from hw) as total, round((select count(*) from m where speaker = t) / (select count(*) from hw), 6) as accuracy""")
def attribution_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _sides(spark, sf_dir)
    words = N.word_times(own, X.words(F.col("text"))).select("meeting", "seq", "pos", "speaker", F.col("word_start").alias("start_ms"), F.col("word_end").alias("end_ms"))
    heard = words.drop("speaker").join(found.select("meeting", "seq", "speaker"), ["meeting", "seq"])
    return E.attribution(heard, words, 200).withColumn("accuracy", F.round("accuracy", 6))


@query()
def sa_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each true speaker's whole text against what was heard of that speaker in the meeting, weighted by words."""
    own, found = _sides(spark, sf_dir)
    words = own.select("meeting", "seq", "speaker", X.tokens(F.col("text")).alias("words"))
    heard = words.drop("speaker").join(found.select("meeting", "seq", "speaker"), ["meeting", "seq"])
    out = E.corpus_errors(E.speaker_errors(words, heard), "speaker")
    return out.select("speaker", "substitutions", "insertions", "deletions", F.col("n_reference").alias("n_words"), F.round("error_rate", 6).alias("wer"))
