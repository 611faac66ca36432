"""Queries on energy frames, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import dedup, folds, speech, windows
from parley.plans import views
from parley.plans.registry import query
from parley.plans.views import FRAMES
from parley.session import shared_dir
from parley.streaming import live
from parley.streaming import sessions as S

RUNS = f"""{FRAMES}, r0 as (select *, energy > 0.3 as speech, case when (energy > 0.3) = lag(energy > 0.3) over (partition by stream order by t_us, seq) then 0 else 1 end as fresh from frames),
r as (select *, sum(fresh) over (partition by stream order by t_us, seq) as run from r0)"""
HALF_HOUR = 1_800_000_000


@query(f"with {RUNS} select stream, speech, max(n) as longest, count(*) as runs from (select stream, run, speech, count(*) as n from r group by 1, 2, 3) group by 1, 2")
def frame_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.runs(views.frames(spark, sf_dir), F.col("energy") > 0.3)
    return out.groupBy("stream", "run", "speech").agg(F.count("*").alias("n")).groupBy("stream", "speech").agg(F.max("n").alias("longest"), F.count("*").alias("runs"))


@query(f"""with {FRAMES}, t as (select stream, seq, avg(energy) over w as mean10, var_pop(energy) over w as var10, count(*) over w as n10, sum(case when energy <= 0.3 then 1 else 0 end) over (partition by stream order by t_us, seq rows between 7 preceding and current row) as silent8
from frames window w as (partition by stream order by t_us, seq rows between 9 preceding and current row))
select seq, round(mean10, 8) as mean10, round(var10, 8) as var10, silent8::bigint as silent8, n10 >= 10 and var10 between 0.05 and 0.5 as natural from t""")
def boundary_trailing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = speech.trailing(views.frames(spark, sf_dir), 0.3)
    return out.select("seq", F.round("mean10", 8).alias("mean10"), F.round("var10", 8).alias("var10"), "silent8", speech.natural(out).alias("natural"))


@query(f"""with {RUNS}, s as (select stream, run, min(t_us) as start_us, max(t_us) as end_us, count(*) as n, list(energy order by t_us, seq) as e from r where speech group by 1, 2)
select stream, run::bigint as run, start_us, end_us, n, round(list_reduce(e, lambda a, x: (a + x) / 2), 6) as confidence from s where end_us - start_us >= 60000000""")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.segments(views.frames(spark, sf_dir), 0.3, 60_000_000).withColumn("confidence", F.round("confidence", 6))


_SESSIONS = f"""with {FRAMES}, g as (select *, case when t_us - lag(t_us) over (partition by stream order by t_us, seq) < {HALF_HOUR} then 0 else 1 end as fresh from frames),
s as (select *, sum(fresh) over (partition by stream order by t_us, seq) as session from g)"""


@query(f"{_SESSIONS} select stream, session::bigint as session, min(t_us) as start_us, max(t_us) as end_us, count(*) as n from s group by 1, 2")
def vad_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.sessions(views.frames(spark, sf_dir), HALF_HOUR)


@query(f"""with {FRAMES}, w as (select stream, energy, unnest(range(t_us // 900000000 - 3, t_us // 900000000 + 1)) * 900000000 as start_us, t_us from frames)
select stream, start_us, count(*) as n, round(avg(energy), 6) as mean, max(energy) as peak from w where t_us < start_us + 3600000000 group by 1, 2""")
def sliding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.frames(spark, sf_dir).groupBy("stream", F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("energy"), 6).alias("mean"), F.max("energy").alias("peak"))
    return rows.select("stream", F.unix_micros("w.start").alias("start_us"), "n", "mean", "peak")


@query(f"with {FRAMES}, k as (select *, row_number() over (partition by stream order by t_us, seq) as k from frames) select seq from k where (k - 1) % 3 = 0")
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.throttled(views.frames(spark, sf_dir), 3).select("seq")


@query(f"""with {FRAMES}, u as (select *, coalesce(lead(energy, 4) over (partition by stream order by t_us, seq) - energy > 0.1, false) as up from frames)
select stream, max(energy) as peak, round(avg(energy), 6) as mean, round(arg_max(energy, (t_us, seq)) - arg_min(energy, (t_us, seq)), 6) as change, count(*) filter (where up) as growing from u group by 1""")
def trend_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.trend(views.frames(spark, sf_dir), 5, 0.1).select("stream", "peak", F.round("mean", 6).alias("mean"), F.round("change", 6).alias("change"), "growing")


@query("select event_type, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(stddev_pop(value), 6) as spread, count(*) as n from events group by 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.session import table

    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.percentile("value", F.lit(0.99)), 6).alias("p99"), F.round(F.stddev_pop("value"), 6).alias("spread"), F.count("*").alias("n"))


@query(f"""with {FRAMES}, l as (select stream, list(t_us order by t_us) as ts from frames group by 1),
f as (select stream, list_reduce(list_transform(ts, lambda t: [t]), lambda a, x: case when x[1] - a[len(a)] >= {HALF_HOUR} then list_append(a, x[1]) else a end) as kept from l)
select stream, unnest(kept) as t_us from f""")
def change_point_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.spaced(views.frames(spark, sf_dir), HALF_HOUR, "stream", "t_us")


def _streamed(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives that has read all there is, from files in the shared folder."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    S.run_once(stream, f"{place}/out", f"{place}/checkpoint", mode)
    return spark.read.parquet(f"{place}/out")


def _replayed(spark: SparkSession, events: DataFrame, fold: folds.Fold, key: str, stretch: int) -> DataFrame:
    """A fold over a stream up to its end."""
    return live.replay(events, lambda both: live.folded(both, fold, key, stretch=stretch), f"{shared_dir(spark)}/live-{uuid.uuid4().hex}")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return S.stream_table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), ts.alias("ts"), F.unix_micros(ts).alias("t_us"), (F.col("value") / 500).alias("energy"))


@query(f"""{_SESSIONS}, w as (select stream, session, min(t_us) as start_us, max(t_us) + {HALF_HOUR} as end_us, count(*) as n from s group by 1, 2), m as (select max(t_us) as top from frames)
select stream, start_us, end_us, n from w, m where end_us < (top // 1000 - 5000) * 1000""")
def stream_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    out = _streamed(spark, S.session_windows(_live(spark, sf_dir), "30 minutes"))
    return out.select("stream", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = S.stream_table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, S.first_seen(live, "user_id", "event_type", late="3650 days")).select("user_id", "event_type")


@query()
def stream_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times here are minutes apart, so a second of the policy stands for ten minutes."""
    return _replayed(spark, _live(spark, sf_dir), folds.Silences(0.3, unit_us=600_000_000), "stream", 3_600_000_000)


@query()
def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = S.stream_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    return _replayed(spark, dedup.marked(views.timed(live)), folds.Repeats(), "meeting", 600_000_000).select("meeting", "seq", "duplicate")
