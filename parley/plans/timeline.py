"""Queries on segments in time: filters, windows, interval joins, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import intervals as I
from parley.operators import windows as N
from parley.plans import views
from parley.plans.registry import query
from parley.plans.views import PREDICTED, SEGMENTS, SQL_WORDS

OVERLAP = "greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))"
MEET = "a.meeting = b.meeting and a.start_ms < b.end_ms and a.end_ms > b.start_ms"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = views.segments(spark, sf_dir)
    return own, views.predicted(own)


@query(f"with {SEGMENTS} select meeting, seq, speaker from segments where speaker in ('user', 'system') and contains(lower(text), 'en')")
def segment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.segments(spark, sf_dir)
    return rows.where(F.col("speaker").isin("user", "system") & F.lower("text").contains("en")).select("meeting", "seq", "speaker")


@query(f"with {SEGMENTS} select meeting, min(seq) as seq from segments where 20000 between start_ms and end_ms group by 1")
def segment_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.at_time(views.segments(spark, sf_dir), 20_000)


@query(f"with {SEGMENTS} select meeting, seq, start_ms, end_ms from segments where start_ms < 40000 and end_ms > 10000")
def segments_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.within(views.segments(spark, sf_dir), 10_000, 40_000).select("meeting", "seq", "start_ms", "end_ms")


@query(f"""with {PREDICTED}, m as (select *, max(start_ms) over (partition by meeting order by seq rows between unbounded preceding and 1 preceding) as latest from predicted)
select meeting, seq, start_ms >= 0 and end_ms > start_ms and end_ms - start_ms between 100 and 60000 and (latest is null or start_ms >= latest - 5000) as valid from m""")
def timing_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.validity(_both(spark, sf_dir)[1]).select("meeting", "seq", "valid")


@query(f"""with {SEGMENTS}, g as (select meeting, end_ms as gap_start, lead(start_ms) over (partition by meeting order by start_ms, seq) as gap_end from segments)
select * from g where gap_end - gap_start >= 400""")
def silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.gaps(views.segments(spark, sf_dir), 400)


@query(f"""with {SEGMENTS}, s as (select meeting, case when speaker <> lag(speaker) over (partition by meeting order by start_ms, seq) then 1 else 0 end as s from segments)
select meeting, sum(s)::bigint as switches from s group by 1""")
def speaker_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.switches(views.segments(spark, sf_dir))


@query(f"""with {PREDICTED}, c as (select p.*, n_words, case when p.speaker = lag(p.speaker) over (partition by p.meeting order by p.seq) then 0 else 1 end as fresh from predicted p join segments s using (meeting, seq)),
i as (select *, sum(fresh) over (partition by meeting order by seq) as island from c)
select meeting, island::bigint as island, min(speaker) as speaker, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n, sum(n_words)::bigint as n_words from i group by 1, 2""")
def turn_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _both(spark, sf_dir)
    return N.turn_islands(found.join(own.select("meeting", "seq", "n_words"), ["meeting", "seq"]))


@query(f"""with {SEGMENTS}, r as (select *, max(end_ms) over (partition by meeting order by start_ms, seq rows between unbounded preceding and 1 preceding) as reach from segments),
i as (select *, sum(case when reach is null or start_ms > reach + 100 then 1 else 0 end) over (partition by meeting order by start_ms, seq) as island from r),
g as (select meeting, island, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n, list(confidence order by start_ms, seq) as c from i group by 1, 2)
select meeting, island::bigint as island, start_ms, end_ms, n, round(list_reduce(c, lambda a, x: (a + x) / 2), 6) as confidence from g""")
def merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.merge_islands(views.segments(spark, sf_dir), 100).withColumn("confidence", F.round("confidence", 6))


@query(f"""with {SEGMENTS}, w as (select meeting, seq, start_ms, end_ms, n_words as n, unnest({SQL_WORDS.format("text")}) as word, generate_subscripts({SQL_WORDS.format("text")}, 1) - 1 as pos from segments)
select meeting, seq, pos::bigint as pos, word, start_ms + floor((end_ms - start_ms) * pos / n)::bigint as word_start, start_ms + floor((end_ms - start_ms) * (pos + 1) / n)::bigint as word_end from w""")
def word_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.word_times(views.segments(spark, sf_dir), X.words(F.col("text"))).select("meeting", "seq", F.col("pos").cast("long").alias("pos"), "word", "word_start", "word_end")


@query(f"with {PREDICTED} select a.meeting, a.seq, b.seq as predicted_seq, {OVERLAP} as overlap from segments a join predicted b on {MEET} where {OVERLAP} > 0.5 * (a.end_ms - a.start_ms)")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _both(spark, sf_dir)
    pairs = I.overlap_join(own, found).where(F.col("overlap") > 0.5 * (F.col("l_end_ms") - F.col("l_start_ms")))
    return pairs.select(F.col("l_meeting").alias("meeting"), F.col("l_seq").alias("seq"), F.col("r_seq").alias("predicted_seq"), "overlap")


@query(f"""with {PREDICTED}, k as (select a.meeting, a.seq, b.seq as true_seq, b.speaker as true_speaker, {OVERLAP} as overlap, row_number() over (partition by a.meeting, a.seq order by {OVERLAP} desc, b.seq) as k from predicted a join segments b on {MEET})
select meeting, seq, true_seq, true_speaker, overlap from k where k = 1 and overlap > 0""")
def best_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _both(spark, sf_dir)
    return I.best_overlap(found, own).select(F.col("l_meeting").alias("meeting"), F.col("l_seq").alias("seq"), F.col("r_seq").alias("true_seq"), F.col("r_speaker").alias("true_speaker"), "overlap")


@query(f"with {SEGMENTS} select a.meeting, a.seq as a, b.seq as b, {OVERLAP} as overlap from segments a join segments b on {MEET} and a.seq < b.seq")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlapping_pairs(views.segments(spark, sf_dir)).select(F.col("l_meeting").alias("meeting"), F.col("l_seq").alias("a"), F.col("r_seq").alias("b"), "overlap")


@query(f"with {SEGMENTS} select meeting, seq from segments a where exists (select 1 from segments b where {MEET} and a.seq <> b.seq)")
def conflict_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.segments(spark, sf_dir)
    return I.conflicts(own, own).select("meeting", "seq")


@query(f"with {SEGMENTS} select a.meeting, a.seq, count(*) as others from segments a join segments b on {MEET} and a.speaker <> b.speaker group by 1, 2")
def overlap_other_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.segments(spark, sf_dir)
    return I.overlap_join(own, own).where("l_speaker <> r_speaker").groupBy(F.col("l_meeting").alias("meeting"), F.col("l_seq").alias("seq")).agg(F.count("*").alias("others"))


def pieces_sql(transcript: str, speakers: str, least: float = 0.5) -> str:
    """CTE ``pieces``: every piece of every transcript segment, as ``intervals.align`` makes them."""
    return f"""f0 as (select a.meeting, a.seq, list(struct_pack(o := {OVERLAP}, s := b.speaker, c := b.confidence) order by {OVERLAP} desc, b.start_ms, b.seq) as found
from {transcript} a join {speakers} b on {MEET} where {OVERLAP} > {least} * (a.end_ms - a.start_ms) group by 1, 2),
f1 as (select t.*, found, coalesce(len(found), 0) as n, {SQL_WORDS.format("text")} as ws from {transcript} t left join f0 using (meeting, seq)),
f2 as (select *, unnest(range(greatest(n, 1)))::bigint as part from f1),
f3 as (select *, start_ms + coalesce(list_sum(list_transform(found[1:part], lambda x: x.o)), 0)::bigint as begun from f2),
pieces as (select meeting, seq, part, case when n = 0 then 'unknown_speaker' else found[part + 1].s end as speaker, begun as start_ms, case when n > 1 then least(begun + found[part + 1].o, end_ms) else end_ms end as end_ms,
case when n = 0 then confidence * 0.5 else (confidence + found[part + 1].c) / 2 end as overall, case when n < 2 or part = n - 1 then text else array_to_string(ws[1:round(len(ws) * found[part + 1].o / (end_ms - start_ms))::int], ' ') end as text
from f3 where n < 2 or begun < end_ms)"""


@query(f"""with {PREDICTED}, {pieces_sql("segments", "predicted")} select meeting, seq, part, speaker, start_ms, end_ms, round(overall, 6) as overall, md5(text) as digest from pieces""")
def align_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every segment, those of several speakers too."""
    own, found = _both(spark, sf_dir)
    return I.align(own, found).select("meeting", "seq", F.col("part").cast("long").alias("part"), "speaker", "start_ms", "end_ms", F.round("overall", 6).alias("overall"), F.md5("text").alias("digest"))


@query(f"""with {PREDICTED}, f as (select a.meeting, a.seq, any_value(a.start_ms) as start_ms, any_value(a.end_ms) as end_ms, any_value(a.text) as text, any_value(a.confidence) as c, list(struct_pack(o := {OVERLAP}, s := b.speaker, c := b.confidence) order by {OVERLAP} desc, b.start_ms, b.seq) as found
from segments a join predicted b on {MEET} where {OVERLAP} > 0.02 * (a.end_ms - a.start_ms) group by 1, 2),
p as (select *, {SQL_WORDS.format("text")} as ws, unnest(range(len(found))) as i from f where len(found) > 1),
w as (select *, start_ms + coalesce(list_sum(list_transform(found[1:i], lambda x: x.o)), 0)::bigint as begun from p)
select meeting, seq, i as part, found[i + 1].s as speaker, begun as start_ms, least(begun + found[i + 1].o, end_ms) as end_ms, round((c + found[i + 1].c) / 2, 6) as overall,
case when i = len(found) - 1 then text else array_to_string(ws[1:round(len(ws) * found[i + 1].o / (end_ms - start_ms))::int], ' ') end as text from w where begun < end_ms qualify count(*) over (partition by meeting, seq) > 1""")
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _both(spark, sf_dir)
    pieces = I.align(own, found, 0.02)
    several = pieces.groupBy("meeting", "seq").agg(F.max("part").alias("_m")).where("_m > 0")
    split = pieces.join(several, ["meeting", "seq"], "left_semi")
    return split.select("meeting", "seq", F.col("part").cast("long").alias("part"), "speaker", "start_ms", "end_ms", F.round("overall", 6).alias("overall"), "text")


@query(f"""with {SEGMENTS}, k as (select *, greatest(ceil((end_ms - start_ms) / 8000), 1)::bigint as n from segments), p as (select *, unnest(range(n)) as part from k)
select meeting, seq, part, start_ms + floor((end_ms - start_ms) * part / n)::bigint as part_start, start_ms + floor((end_ms - start_ms) * (part + 1) / n)::bigint as part_end from p""")
def split_long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.split_long(views.segments(spark, sf_dir), 8000).select("meeting", "seq", "part", "part_start", "part_end")


@query(f"""with {SEGMENTS}, l as (select meeting, list(struct_pack(s := start_ms, q := seq, e := end_ms) order by start_ms, seq) as xs from segments group by 1),
r as (select meeting, list_reduce(list_transform(xs, lambda x: struct_pack(g := 0, e := x.e, s := x.s, q := x.q, out := [struct_pack(g := 0, q := x.q)])),
 lambda a, x: struct_pack(g := case when x.s < a.e then a.g else a.g + 1 end, e := case when x.s < a.e then a.e else x.e end, s := x.s, q := x.q, out := list_append(a.out, struct_pack(g := case when x.s < a.e then a.g else a.g + 1 end, q := x.q)))) as r from l),
m as (select meeting, unnest(r.out) as m from r)
select meeting, m.g::bigint as g, count(*) as members, min(m.q) as first_seq from m group by 1, 2 having count(*) > 1""")
def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.overlap_groups(views.segments(spark, sf_dir)).withColumn("g", F.col("g").cast("long"))


@query(f"""with {SEGMENTS}, k as (select *, row_number() over (partition by meeting order by start_ms desc, seq desc) as k from segments) select meeting, seq from k where k <= 3""")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.newest(views.segments(spark, sf_dir), 3).select("meeting", "seq")


@query(f"""with {PREDICTED}, l as (select meeting, list(struct_pack(a := start_ms::double, b := end_ms::double, who := speaker, c := confidence, n := 1::bigint) order by start_ms, seq) as xs from predicted group by 1),
r as (select meeting, list_reduce(list_transform(xs, lambda x: struct_pack(now := x, out := list_filter([x], lambda y: false))), lambda acc, nx:
 case when acc.now.b > nx.now.a and acc.now.who = nx.now.who then struct_pack(now := struct_pack(a := acc.now.a, b := nx.now.b, who := acc.now.who, c := (acc.now.c + nx.now.c) / 2, n := acc.now.n + 1), out := acc.out)
 when acc.now.b > nx.now.a then struct_pack(now := struct_pack(a := (acc.now.b + nx.now.a) / 2, b := nx.now.b, who := nx.now.who, c := nx.now.c, n := nx.now.n), out := list_append(acc.out, struct_pack(a := acc.now.a, b := (acc.now.b + nx.now.a) / 2, who := acc.now.who, c := acc.now.c, n := acc.now.n)))
 else struct_pack(now := nx.now, out := list_append(acc.out, struct_pack(a := acc.now.a, b := case when nx.now.a - acc.now.b > 100 and nx.now.a - acc.now.b < 1000 then nx.now.a else acc.now.b end, who := acc.now.who, c := acc.now.c, n := acc.now.n))) end) as r from l),
f as (select meeting, list_append(r.out, r.now) as o from r), u as (select meeting, unnest(o) as p, generate_subscripts(o, 1) - 1 as part from f)
select meeting, part::bigint as part, p.a as start_ms, p.b as end_ms, p.who as speaker, round(p.c, 6) as confidence, p.n as n from u""")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.resolve(_both(spark, sf_dir)[1], 1000)
    return out.select("meeting", F.col("part").cast("long").alias("part"), "start_ms", "end_ms", "speaker", F.round("confidence", 6).alias("confidence"), F.col("n").cast("long").alias("n"))


WORDS_SQL = f"""w0 as (select meeting, seq, speaker, start_ms, end_ms, n_words as n, unnest({SQL_WORDS.format("text")}) as word, generate_subscripts({SQL_WORDS.format("text")}, 1) - 1 as pos from segments),
words as (select meeting, seq, speaker, pos, start_ms + floor((end_ms - start_ms) * pos / n)::bigint as start_ms, start_ms + floor((end_ms - start_ms) * (pos + 1) / n)::bigint as end_ms from w0)"""


@query(f"""with {PREDICTED}, {WORDS_SQL}, m as (select a.meeting, a.seq, a.pos, a.speaker as true_speaker, arg_min(b.speaker, b.seq) as found_speaker from words a join predicted b on {MEET} where {OVERLAP} > 200 group by 1, 2, 3, 4)
select true_speaker, found_speaker, count(*) as words from m group by 1, 2""")
def word_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _both(spark, sf_dir)
    words = N.word_times(own, X.words(F.col("text"))).select("meeting", "seq", "pos", "speaker", F.col("word_start").alias("start_ms"), F.col("word_end").alias("end_ms"))
    pairs = I.overlap_join(words, found).where("overlap > 200")
    first = pairs.groupBy("l_meeting", "l_seq", "l_pos", F.col("l_speaker").alias("true_speaker")).agg(F.min_by("r_speaker", "r_seq").alias("found_speaker"))
    return first.groupBy("true_speaker", "found_speaker").agg(F.count("*").alias("words"))


@query(f"""with {SEGMENTS}, l as (select meeting, seq, start_ms, row_number() over (partition by meeting order by start_ms, seq) as i,
printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) as t, speaker || ': ' || text as s from segments)
select meeting, md5(string_agg(i || chr(10) || t || chr(10) || s || chr(10), chr(10) order by i)) as digest from l group by 1""")
def caption_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.sources.documents import captions

    return captions(views.segments(spark, sf_dir)).select("meeting", F.md5("body").alias("digest"))


@query(f"with {SEGMENTS} select meeting, seq, start_ms from segments s where not exists (select 1 from segments b where b.meeting = s.meeting and b.seq = s.seq - 1 and b.speaker = s.speaker) and seq > 0")
def speaker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.segments(spark, sf_dir)
    before = own.select("meeting", (F.col("seq") + 1).alias("seq"), "speaker")
    return own.where("seq > 0").join(before, ["meeting", "seq", "speaker"], "left_anti").select("meeting", "seq", "start_ms")
