"""Queries on boundaries, buffering and live state of streams, and on windows of samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import signal as S
from parley.functions import text as X
from parley.functions import vector as V
from parley.operators import boundaries as B
from parley.operators import intervals as I
from parley.operators import folds, speech, windows
from parley.plans import views
from parley.plans.registry import query
from parley.plans.signals import _live, _replayed, _streamed
from parley.plans.views import FRAMES, PREDICTED, SEGMENTS, VOICES
from parley.session import shared_dir, table
from parley.streaming import sessions

#: Event times here are minutes apart, so a millisecond of the policy stands for six seconds.
POLICY, UNIT = B.Policy(silence=0.05, soft_ms=200, hard_ms=400, speech_ms=1000, least_variance=0.002, shortest_ms=1500, longest_ms=4000, rest_ms=3000), 6_000_000

KINDS = f"""{FRAMES}, r0 as (select *, energy > 0.05 as speech, case when (energy > 0.05) = lag(energy > 0.05) over o then 0 else 1 end as fresh, avg(energy) over (o rows between 9 preceding and current row) as m10, var_pop(energy) over (o rows between 9 preceding and current row) as v10, count(*) over (o rows between 9 preceding and current row) as n10,
sum((energy <= 0.05)::int) over (o rows between 7 preceding and current row) as silent8, sum((energy > 0.05)::int) over (o rows between 49 preceding and current row) as heard, sum((energy > 0.05)::int) over (o rows between unbounded preceding and current row) as nth from frames window o as (partition by stream order by t_us, seq)),
r1 as (select *, sum(fresh) over (partition by stream order by t_us, seq) as run, case when speech then (energy > lag(energy) over (partition by stream, speech order by t_us, seq))::int end as rise, case when speech then avg(energy) over (partition by stream, speech order by t_us, seq rows between 19 preceding and current row) end as loud from r0),
r2 as (select *, row_number() over (partition by stream, run order by t_us, seq) as in_run, case when speech then sum(rise) over (partition by stream, speech order by t_us, seq rows between 8 preceding and current row) end as rises from r1),
r3 as (select *, last_value(loud ignore nulls) over o as loud_, last_value(rises ignore nulls) over o as rises_, case when speech then 0 else in_run end as quiet_run, case when speech then in_run else 0 end as speech_run from r2 window o as (partition by stream order by t_us, seq rows between unbounded preceding and current row)),
r4 as (select *, heard >= 10 and quiet_run >= 4 and nth >= 5 and (energy < 0.2 * loud_ or silent8 >= 6) as hard from r3),
r5 as (select *, max(case when hard then t_us end) over (partition by stream order by t_us, seq rows between unbounded preceding and 1 preceding) as before from r4),
k as (select *, case when hard then 'hard' when heard >= 10 and quiet_run >= 2 and (before is null or t_us - before >= 6000000000) and n10 >= 10 and v10 between 0.002 and 0.5 then 'soft' when heard >= 10 and nth >= 10 and rises_ >= 7 then 'sentence_end' else 'none' end as kind from r5)"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.classify(views.frames(spark, sf_dir), POLICY, unit_us=UNIT)


@query(f"with {KINDS} select seq, kind, quiet_run::bigint as quiet_run, speech_run::bigint as speech_run from k")
def boundary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).select("seq", "kind", F.col("quiet_run").cast("long").alias("quiet_run"), F.col("speech_run").cast("long").alias("speech_run"))


@query(f"""with {KINDS} select seq, (seq * 131 % 5000) < 1000 or (speech_run > 0 and quiet_run < 3) or ((seq * 131 % 5000) < 3000 and kind in ('none', 'soft')) as waits,
max(case when energy <= 0.05 then t_us end) over (partition by stream order by t_us, seq rows between 49 preceding and 4 preceding) as point_us from k""")
def buffering_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether to wait with so much held (made of the number of the frame), and the best point to end at."""
    rows = _kinds(spark, sf_dir).withColumn("point_us", B.best_point(None, POLICY))
    return rows.select("seq", B.keep_buffering(F.col("seq") * 131 % 5000, POLICY).alias("waits"), "point_us")


@query()
def boundary_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.in_order(views.frames(spark, sf_dir), folds.Utterances(POLICY, UNIT), "stream")


@query()
def stream_boundary_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, live: frames wait until the watermark has passed them, and silence or the end closes."""
    return _replayed(spark, _live(spark, sf_dir), folds.Utterances(POLICY, UNIT), "stream", HOUR)


@query(f"with {FRAMES} select seq, max(energy) over (partition by stream order by t_us range between 3599999999 preceding and current row) as peak from frames")
def peak_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.peaks(views.frames(spark, sf_dir), 3_600_000_000).select("seq", "peak")


@query(f"""with {SEGMENTS}, g as (select meeting, lead(start_ms) over (partition by meeting, speaker order by start_ms, seq) - end_ms as g from segments)
select meeting, max(g) as longest, coalesce(bool_and(g <= 30000), true) as steady from g group by 1""")
def speaker_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.steady(views.segments(spark, sf_dir), 30_000)


@query(f"""with {SEGMENTS}, c as (select *, case when speaker <> lag(speaker) over (partition by meeting order by start_ms, seq) then 1 else 0 end as c from segments)
select meeting, sum(c)::bigint as changes, round(avg(end_ms - start_ms), 6) as mean_ms, round(case when sum(end_ms - start_ms) > 0 then 60000.0 * sum(n_words) / sum(end_ms - start_ms) end, 6) as words_a_minute from c group by 1""")
def speaking_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.segments(spark, sf_dir)
    length = F.col("end_ms") - F.col("start_ms")
    sums = rows.groupBy("meeting").agg(F.round(F.avg(length), 6).alias("mean_ms"), F.round(F.when(F.sum(length) > 0, 60000.0 * F.sum("n_words") / F.sum(length)), 6).alias("words_a_minute"))
    return windows.switches(rows).select("meeting", F.col("switches").alias("changes")).join(sums, "meeting")


@query(f"""with {SEGMENTS}, e as (select meeting, seq, speaker, start_ms as t, seq % 3 <> 2 as active from segments), s as (select meeting, speaker, arg_max(active, (t, seq)) as active, max(t) as last from e group by 1, 2), n as (select meeting, arg_max(speaker, (t, seq)) as who from e where active group by 1)
select s.meeting, speaker, active, last, coalesce(active and speaker = who, false) as current from s left join n using (meeting)""")
def speaker_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.segments(spark, sf_dir).select("meeting", "seq", "speaker", F.col("start_ms").alias("t"), (F.col("seq") % 3 != 2).alias("active"))
    return speech.activity(events)


@query(f"""with {SEGMENTS}, d as (select meeting, sum(end_ms - start_ms) / 1000 as done, (max(end_ms) - min(start_ms)) / 1000 as played from segments group by 1)
select meeting, round(case when played > 0 then done / played else 0 end, 6) as factor, case when played > 0 then done / played else 0 end >= 0.95 as keeps_up from d""")
def realtime_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = views.segments(spark, sf_dir).groupBy("meeting").agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 1000).alias("done"), ((F.max("end_ms") - F.min("start_ms")) / 1000).alias("played"))
    factor, keeps = speech.real_time(F.col("done"), F.col("played"))
    return sums.select("meeting", F.round(factor, 6).alias("factor"), keeps.alias("keeps_up"))


@query(f"with {FRAMES}, p as (select stream, count(*) * 1600 as position from frames group by 1) select count(*) as consumers, round(avg(greatest(100000 - position, 0)), 6) as mean_lag, 1.0::double as utilization from p")
def buffer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers = views.frames(spark, sf_dir).groupBy("stream").agg((F.count("*") * 1600).alias("position"))
    return speech.buffer_stats(readers, F.lit(100_000), 80_000).withColumn("mean_lag", F.round("mean_lag", 6))


@query(f"with {FRAMES} select seq, epoch_us(ts - interval 2 hour) as earlier_us, epoch_us(ts + interval 1 day) as later_us from frames")
def time_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("seq", F.unix_micros(X.shifted(F.col("ts"), hours=-2)).alias("earlier_us"), F.unix_micros(X.shifted(F.col("ts"), days=1)).alias("later_us"))


@query(f"with {PREDICTED} select a.meeting, a.seq, abs(a.start_ms - b.start_ms) <= 600 and abs(a.end_ms - b.end_ms) <= 600 as same from segments a join predicted b using (meeting, seq)")
def timing_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.segments(spark, sf_dir)
    other = views.predicted(own).select("meeting", "seq", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    return own.join(other, ["meeting", "seq"]).select("meeting", "seq", I.same_timing(F.col("start_ms"), F.col("end_ms"), F.col("s2"), F.col("e2"), 600).alias("same"))


@query()
def timing_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.segments(spark, sf_dir)
    rows = views.predicted(own).join(own.select("meeting", "seq", "text"), ["meeting", "seq"])
    return _told(folds.in_order(views.timed(rows), folds.Correction(), "meeting"))


def _told(corrected: DataFrame) -> DataFrame:
    return corrected.select("meeting", "seq", "start_ms", "end_ms", "speaker", F.round("confidence", 6).alias("confidence"), F.md5("text").alias("digest"), "merged")


@query()
def stream_timing_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, live: segments come late and in any order and are taken in by number."""
    turns = sessions.stream_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    timing = views.predicted(views.segments(spark, sf_dir)).select(F.col("meeting").alias("_m"), F.col("seq").alias("_s"), "start_ms", "end_ms", "confidence", F.col("speaker").alias("_who"))
    rows = turns.join(timing, (F.col("meeting") == F.col("_m")) & (F.col("seq") == F.col("_s"))).select("meeting", "seq", "start_ms", "end_ms", "text", F.col("_who").alias("speaker"), "confidence")
    return _told(_replayed(spark, views.timed(rows), folds.Correction(), "meeting", 600_000_000))


def _chunks(voices: DataFrame) -> DataFrame:
    """Chunks made of voice vectors, one speaker's in order as a stream; ``_samples`` are theirs."""
    return voices.select(F.col("speaker_id").alias("stream"), F.col("id").alias("seq"), "vector")


def _samples() -> Column:
    """The samples of a chunk, its vector again and again; some chunks are long, some short."""
    times = (20 + F.col("seq") % 7 * 40).cast("int")
    return F.flatten(F.array_repeat(F.transform("vector", lambda x: x * (0.02 + F.col("seq") % 4 * 0.1)), times))


def _heard(found: DataFrame) -> DataFrame:
    return found.select("stream", "seq", F.round("offset_s", 6).alias("offset_s"), F.size("segments").cast("long").alias("n"), F.round(F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["end_s"] - x["start_s"]), 6).alias("speech_s"), F.round("confidence", 6).alias("confidence"), F.round("threshold", 6).alias("threshold"), F.round("snr_db", 6).alias("snr_db"), "clipping")


VAD = folds.VoiceActivity(least_ms=100, most_ms=600)


@query()
def vad_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heard(folds.in_order(views.timed(_chunks(views.voices(spark, sf_dir))), VAD, "stream", samples=_samples()))


@query()
def stream_vad_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.stream_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("speaker_id"), V.doubles(F.col("embedding")).alias("vector"))
    return _heard(_replayed(spark, views.timed(_chunks(rows)).withColumn("samples", _samples()), VAD, "stream", 6_000_000_000))


@query()
def stream_cluster_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster_online``, live: a map of cluster sums for each recording."""
    rows = sessions.stream_table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).cast("long").alias("recording"), F.col("vec_id").alias("seq"), V.doubles(F.col("embedding")).alias("vector"))
    out = _replayed(spark, views.timed(rows), folds.OnlineClusters(0.3), "recording", 600_000_000)
    return out.select("recording", F.col("seq").alias("id"), "cluster")


HOUR = 3_600_000_000


@query(f"""with {FRAMES}, d as (select *, unnest(range(greatest(floor((t_us - 10 * {HOUR}) / (5 * {HOUR}))::bigint + 1, 0), t_us // (5 * {HOUR}) + 1)) as win from frames),
m as (select *, energy > 0.05 as loud, lead(t_us) over o as nxt, lead(energy) over o as aft, case when (energy > 0.05) = lag(energy > 0.05) over o then 0 else 1 end as fresh from d window o as (partition by stream, win order by t_us, seq)),
u as (select *, sum(fresh) over (partition by stream, win order by t_us, seq) as run from m),
p as (select stream, win, min(t_us) as s, arg_max(coalesce(nxt, t_us + {HOUR // 4}), (t_us, seq)) as e, arg_max(coalesce(least(aft, 1.0), 0.8), (t_us, seq)) as c from u where loud group by stream, win, run),
q as (select * from p where e - s >= {HOUR}), r as (select *, max(e) over (partition by stream order by s, win rows between unbounded preceding and 1 preceding) as reach from q),
i as (select *, sum(case when reach is null or s > reach + 600000000 then 1 else 0 end) over (partition by stream order by s, win) as island from r),
g as (select stream, island, min(s) as start_us, max(e) as end_us, count(*) as n, list(c order by s, win) as cs from i group by 1, 2)
select stream, island::bigint as island, start_us, end_us, n, round(list_reduce(cs, lambda a, x: (a + x) / 2), 6) as confidence from g""")
def window_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten hours every five, as frames are a quarter of an hour or so apart."""
    return speech.windowed(views.frames(spark, sf_dir), 0.05, 10 * HOUR, 5 * HOUR, HOUR, HOUR // 4, 600_000_000).withColumn("confidence", F.round("confidence", 6))


_SUM = "list_sum(list_transform({0}, lambda v: {1}))"


@query(f"""with {VOICES}, x as (select id, vector as x, len(vector) as n, {_SUM.format("vector", "abs(v)")} as mass, {_SUM.format("vector", "v * v")} as power from voices),
c as (select *, list_sum(list_transform(range(n), lambda i: abs(x[i + 1]) * i)) / mass as centre, list_reverse_sort(list_transform(x, lambda v: abs(v))) as big from x)
select id, round(least(sqrt(power / n) * 10, 1), 6) as level, round(centre * 64 / n, 6) as centroid, round(centre * 64 / n / 2, 6) as half_centroid,
round((select min(i) from range(n) t(i) where list_sum(list_transform(x[1:i + 1], lambda v: v * v)) >= 0.85 * power) / n, 6) as energy_rolloff,
round((select min(i) from range(n) t(i) where list_sum(big[1:i + 1]) >= 0.85 * mass) * 64 / n / 2, 6) as sorted_rolloff,
{", ".join(f"round(sqrt(list_sum(list_transform(x[{b * 8 + 1}:{b * 8 + 8}], lambda v: v * v)) / 8), 6) as band{b}" for b in range(4))} from c""")
def signal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vector")
    six = lambda c, name: F.round(c, 6).alias(name)
    rows = views.voices(spark, sf_dir).withColumn("_b", S.band_energies(v))
    return rows.select("id", six(S.level(v), "level"), six(S.frequency_centroid(v, 64), "centroid"), six(S.frequency_centroid(v, 64, True), "half_centroid"), six(S.energy_rolloff(v), "energy_rolloff"), six(S.sorted_rolloff(v, 64), "sorted_rolloff"), *[six(F.col("_b")[b], f"band{b}") for b in range(4)])


@query(f"""with {VOICES}, a as (select id, vector as x, lead(vector) over (order by id) as y, len(vector) as n, {_SUM.format("vector", "v * v")} as power, list_sort(list_transform(vector, lambda v: abs(v))) as small from voices),
q as (select *, case when small[n // 4 + 1] > 0 then 20 * log10(sqrt(power / n) / small[n // 4 + 1]) end as snr, len(list_filter(range(1, n), lambda i: (x[i] >= 0) <> (x[i + 1] >= 0))) / (n - 1) as zc, list_sum(list_transform(range(n), lambda i: abs(x[i + 1]) * i)) / {_SUM.format("x", "abs(v)")} as centre from a)
select id, round(snr, 6) as snr_db, len(list_filter(x, lambda v: abs(v) > 0.95)) > 0.01 * n as clipped, (case when power / n > 0.01 then 0.6 else 0 end + case when centre > 10 and centre < 1000 then 0.4 else 0 end)::double as speech,
least(0.5 + case when snr < 10 then 0.3 when snr < 20 then 0.2 when snr < 30 then 0.1 else 0 end, 0.9)::double as threshold, case when zc > 0.1 and power / n > 0.01 and zc > 0.15 then 'ja' else 'en' end as language,
case when y is null then null else round(sqrt(list_sum(list_transform(range(1, n + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))), 6) end as distance from q""")
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, n = F.col("vector"), F.size("vector")
    rows = views.voices(spark, sf_dir)
    after = rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("_y"))
    power = S.total(F.transform(v, lambda x: x * x)) / n
    snr = S.snr_db(v)
    return rows.join(after, "id", "left").select("id", F.round(snr, 6).alias("snr_db"), S.clipped(v).alias("clipped"), F.round(S.speech_probability(power, S.centroid(v)), 6).alias("speech"), F.round(S.adapted_threshold(snr, 0.5), 6).alias("threshold"), S.guessed_language(S.zero_crossings(v), power)["language"].alias("language"), F.round(F.when(F.col("_y").isNotNull(), S.distance(v, F.col("_y"))), 6).alias("distance"))


_A = "(1 / (2 * pi() * 80.0::double)) / (1 / (2 * pi() * 80.0::double) + 1 / 640.0::double)"


@query(f"""with {VOICES}, h as (select id, vector as x, list_reduce(list_transform(vector, lambda v: struct_pack(x := v, y := v, out := list_transform(range(0), lambda q: 0.0::double))), lambda s, v: struct_pack(x := v.x, y := {_A} * (s.y + v.x - s.x), out := list_append(s.out, {_A} * (s.y + v.x - s.x))), struct_pack(x := vector[1], y := vector[1], out := list_transform(range(0), lambda q: 0.0::double))).out as y from voices),
r as (select *, sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y)) as rms, list_max(list_transform(x, lambda v: abs(v))) as top from h),
e as (select *, list_transform(x, lambda v: case when top > 1 then v / top else v end) as p from r), f as (select *, list_transform(range(len(p)), lambda i: case when i = 0 then p[1] else p[i + 1] - 0.97 * p[i] end) as q from e),
g as (select *, list_transform(range(len(q)), lambda i: case when list_sum(list_transform(q[i // 16 * 16 + 1:i // 16 * 16 + 16], lambda v: v * v)) / 16 < 0.01 then q[i + 1] * 0.1 else q[i + 1] end) as o from f)
select id, round(list_sum(list_transform(range(len(y)), lambda i: y[i + 1] * i)), 6) as filtered, round(case when rms > 0 then list_sum(list_transform(y, lambda v: abs(v))) * 0.1 / rms else 0 end, 6) as levelled, round(list_sum(list_transform(range(len(o)), lambda i: o[i + 1] * i)), 6) as prepared,
round(10 * log10(list_sum(list_transform(x, lambda v: v * v)) / list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - o[i]) * (x[i] - o[i])))), 6) as snr_db from g""")
def signal_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vector")
    place = lambda c: S.total(F.transform(c, lambda x, i: x * i))
    rows = views.voices(spark, sf_dir).select("id", "vector", S.high_pass(v, 640).alias("_h"), S.recogniser_input(v, 16).alias("_o"))
    return rows.select("id", F.round(place(F.col("_h")), 6).alias("filtered"), F.round(S.total(F.transform(S.level_to(F.col("_h")), lambda x: F.abs(x))), 6).alias("levelled"), F.round(place(F.col("_o")), 6).alias("prepared"), F.round(S.snr_between(v, F.col("_o")), 6).alias("snr_db"))


@query()
def diarizer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-pass, level and compounding attenuation of each vector as samples."""
    rows = views.voices(spark, sf_dir).select("id", S.diarizer_input(F.col("vector"), 640, 5.0).alias("_y"))
    return rows.select("id", F.round(S.total(F.transform("_y", lambda x: F.abs(x))), 6).alias("mass"), F.size("_y").cast("long").alias("n"))


_PALETTE = "[" + ", ".join(f"'{c}'" for c in S.PALETTE) + "]"


@query(f"""with {SEGMENTS}, s as (select distinct speaker from segments), h as (select speaker, list_sum(list_transform(string_split(speaker, ''), lambda c: ascii(c))) % 256 % 10 as k from s),
c as (select speaker, {_PALETTE}[k::bigint + 1] as colour from h)
select speaker, colour, case when (0.299 * ('0x' || colour[2:3])::int + 0.587 * ('0x' || colour[4:5])::int + 0.114 * ('0x' || colour[6:7])::int) / 255 > 0.5 then '#000000' else '#ffffff' end as text_colour from c""")
def speaker_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.segments(spark, sf_dir).select("speaker").distinct().select("speaker", S.speaker_colour(F.col("speaker")).alias("colour"))
    return rows.select("speaker", "colour", S.readable_on(F.col("colour")).alias("text_colour"))


@query("""select p_partkey, case when p_retailprice / 100 >= 16 and p_size >= 8 then 'high-accuracy' when p_retailprice / 100 >= 8 and p_size >= 4 then 'standard' else 'turbo' end as tier, p_size < 4 as few_cores,
case when p_partkey % 3 = 0 then 48000 when p_partkey % 3 = 1 then 96000 else 16000 end::bigint as rate from part""")
def system_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, warnings = S.tier(F.col("p_retailprice") / 100, F.col("p_size"))
    arr = lambda *r: F.array(*[F.lit(x) for x in r])
    rates = F.when(F.col("p_partkey") % 3 == 0, arr(44100, 48000)).when(F.col("p_partkey") % 3 == 1, arr(8000, 96000)).otherwise(F.array().cast("array<int>"))
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("tier"), F.array_contains(warnings, "limited_cpu_cores").alias("few_cores"), S.preferred_rate(rates).cast("long").alias("rate"))


@query(f"""with {VOICES}, s as (select id, list_transform(range(16), lambda i: sin(id + i + sin(id * 0.1::double)) * 0.5) as v from voices), u as (select id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from s)
select id, round(list_sum(list_transform(range(16), lambda i: v[i + 1] / n * i)), 6) as weighted from u""")
def seeded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproducible test vectors."""
    own = V.seeded(F.col("id"), F.col("id"), 16)
    return views.voices(spark, sf_dir).select("id", F.round(S.total(F.transform(own, lambda x, i: x * i)), 6).alias("weighted"))


@query("""with d as (select c_custkey as id, list_transform(regexp_extract_all(hex(encode(c_name)), '..'), lambda x: ('0x' || x)::bigint) as digits from customer), h as (select id, list_reduce(list_prepend(0::bigint, digits), lambda s, x: (s * 31 + x) % 4294967296) as seed from d),
t as (select id, seed, list_transform(range(16), lambda i: sin(seed + i + sin(id * 0.1::double)) * 0.5) as v from h)
select id, seed, round(list_sum(list_transform(range(16), lambda i: v[i + 1] * i)) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as weighted from t""")
def named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproducible test vectors of names."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.text_seed(F.col("c_name")).alias("seed"))
    own = V.seeded(F.col("seed"), F.col("id"), 16)
    return rows.select("id", "seed", F.round(S.total(F.transform(own, lambda x, i: x * i)), 6).alias("weighted"))


@query(f"""with {FRAMES}, w as (select stream, t_us // {HOUR} * {HOUR} as start_us, count(*) as n, round(avg(energy), 6) as mean, max(energy) as peak from frames group by 1, 2), m as (select max(t_us) as top from frames)
select stream, start_us, n, mean, peak from w, m where start_us + {HOUR} <= (top // 1000 - 5000) * 1000""")
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour that the watermark has closed."""
    out = _streamed(spark, sessions.framed(_live(spark, sf_dir), "1 hour"))
    return out.select("stream", F.unix_micros("w.start").alias("start_us"), "n", F.round("mean", 6).alias("mean"), "peak")


@query(f"with {FRAMES} select 'audio-level' as event, count(*) as n from frames union all select 'speech', count(*) from frames where energy > 0.3")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    live = _live(spark, sf_dir).select("stream", "seq", "energy")
    sessions.emit(live, f"{place}/out", f"{place}/checkpoint", {"audio-level": F.lit(True), "speech": F.col("energy") > 0.3})
    return spark.read.parquet(f"{place}/out").where(F.get_json_object("payload", "$.seq").isNotNull()).groupBy("event").agg(F.count("*").alias("n"))


def _by_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Speech of streams from windows, and the frames of each stretch of it as samples."""
    own = views.frames(spark, sf_dir)
    found = speech.windowed(own, 0.05, 10 * HOUR, 5 * HOUR, HOUR, HOUR // 4, 600_000_000)
    return found, own


@query()
def diarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech of each stream from sliding windows, a statistics vector for each stretch, clusters of these as speakers."""
    from parley.operators import diarization

    found, own = _by_stream(spark, sf_dir)
    out = diarization.diarize(found, own, 0.5, 4)
    return out.select("stream", "speaker", "segments", "time_us", F.round("confidence", 6).alias("confidence"), "speakers", F.round("overall", 6).alias("overall"))


@query(f"""with {VOICES}, s as (select id // 50 as recording, id, unnest(vector) as x, generate_subscripts(vector, 1) as i from voices),
q as (select recording, greatest(-32768, least(32767, round(x * 4000)))::bigint as v, row_number() over (partition by recording order by id, i) - 1 as place from s)
select recording, count(*) as n_frames, sum(v)::bigint as total, sum(v * place)::bigint as weighted, 8000::bigint as sample_rate from q group by 1""")
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of 50 vectors each as WAV files, read again by ranges of their bytes."""
    from parley.sources import wav

    wav.register(spark)
    place = f"{shared_dir(spark)}/wav-{uuid.uuid4().hex}"
    value = lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(x * 4000))) / 32768
    rows = views.voices(spark, sf_dir).groupBy(F.floor(F.col("id") / 50).alias("recording")).agg(F.array_sort(F.collect_list(F.struct("id", "vector"))).alias("v"))
    rows.select(F.concat(F.lit("r"), F.col("recording").cast("string")).alias("name"), F.lit(8000).alias("sample_rate"), F.transform(F.flatten(F.transform("v", lambda x: x["vector"])), value).alias("samples")).write.format("wav").mode("append").save(place)
    back = spark.read.format("wav").option("partbytes", "4000").load(place)
    each = back.select(F.regexp_extract("path", r"r(\d+)\.wav$", 1).cast("long").alias("recording"), "n_frames", "sample_rate", "start", F.posexplode("samples").alias("i", "x"))
    v = F.round(F.col("x") * 32768).cast("long")
    return each.groupBy("recording").agg(F.max("n_frames").alias("n_frames"), F.sum(v).alias("total"), F.sum(v * (F.col("start") + F.col("i"))).alias("weighted"), F.max("sample_rate").cast("long").alias("sample_rate"))
