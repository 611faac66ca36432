"""Queries on the meeting list and on speakers within meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import meetings as M
from parley.plans import views
from parley.plans.registry import query
from parley.plans.views import MEETINGS, SEGMENTS

STATS = f"""{SEGMENTS}, stats as (select meeting, speaker, sum(end_ms - start_ms)::bigint as time_ms, count(*) as n_segments, avg(confidence) as mean_confidence, min(start_ms) as first_ms, max(end_ms) as last_ms from segments group by 1, 2)"""


@query(f"with {MEETINGS} select id, language, quality from meetings where contains(lower(title), 'the ')")
def meeting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.search(views.meetings(spark, sf_dir), "THE ", "title").select("id", "language", "quality")


@query(f"with {MEETINGS} select id, language, quality, duration_s from meetings where contains(lower(title), 'de') and language not in ('en', 'ja') and quality = 'high'")
def meeting_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.facets(views.meetings(spark, sf_dir), "de", "other", "high").select("id", "language", "quality", "duration_s")


@query(f"with {MEETINGS} select id, duration_s from meetings order by duration_s desc, id")
def meeting_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ordered(views.meetings(spark, sf_dir).select("id", "duration_s"), "duration_s")


@query(f"with {MEETINGS} select count(*) as meetings, floor(sum(duration_s) / 3600)::bigint as hours, sum(speakers)::bigint as speakers, round(avg(accuracy))::bigint as accuracy from meetings")
def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.library_stats(views.meetings(spark, sf_dir))


@query(f"""with {SEGMENTS}, s as (select meeting, string_agg(text, ' ' order by seq, text) as t, avg(confidence) as c, count(distinct speaker) as speakers, max(end_ms) - min(start_ms) as duration_ms from segments group by 1)
select meeting, case when length(t) > 100 then t[1:100] || '...' else t end as preview, speakers, round(round(100 * c, 6))::bigint as accuracy, duration_ms from s""")
def session_to_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.session_rows(views.segments(spark, sf_dir))


@query(f"with {STATS} select meeting, speaker, time_ms, n_segments, round(mean_confidence, 6) as mean_confidence, first_ms, last_ms from stats")
def speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.speaker_stats(views.segments(spark, sf_dir), "meeting").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"with {STATS} select meeting, count(*) as speakers, sum(time_ms)::bigint as time_ms, string_agg(speaker || ':' || n_segments, ',' order by speaker) as segments from stats group by 1")
def meeting_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = M.speaker_stats(views.segments(spark, sf_dir), "meeting")
    each = F.array_join(F.array_sort(F.collect_list(F.concat("speaker", F.lit(":"), F.col("n_segments").cast("string")))), ",")
    return stats.groupBy("meeting").agg(F.count("*").alias("speakers"), F.sum("time_ms").alias("time_ms"), each.alias("segments"))


@query(f"with {STATS}, k as (select *, row_number() over (partition by meeting order by time_ms desc, speaker) as k from stats) select meeting, speaker, time_ms from k where k = 1")
def dominant_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dominant(M.speaker_stats(views.segments(spark, sf_dir), "meeting"))


@query(f"""with {STATS}, p as (select meeting, speaker, time_ms, case when sum(time_ms) over (partition by meeting) > 0 then 100.0::double * time_ms / sum(time_ms) over (partition by meeting) else 0 end as percentage from stats)
select meeting, speaker, round(percentage, 6) as percentage, round(coalesce(sum(percentage) over (partition by meeting order by time_ms desc, speaker rows between unbounded preceding and 1 preceding), 0), 6) as before from p""")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.shares(M.speaker_stats(views.segments(spark, sf_dir), "meeting"))
    return out.select("meeting", "speaker", F.round("percentage", 6).alias("percentage"), F.round("before", 6).alias("before"))


@query(f"""with {SEGMENTS} select speaker, count(distinct meeting) as meetings, sum(end_ms - start_ms)::bigint as time_ms, count(*) as n_segments, round(avg(confidence), 6) as mean_confidence,
min(meeting) as first_meeting, max(meeting) as last_meeting from segments group by 1""")
def speaker_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.segments(spark, sf_dir)
    return rows.groupBy("speaker").agg(F.countDistinct("meeting").alias("meetings"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("time_ms"), F.count("*").alias("n_segments"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("meeting").alias("first_meeting"), F.max("meeting").alias("last_meeting"))


@query(f"""with {SEGMENTS}, m as (select meeting, speaker, avg(confidence) as c, sum(end_ms - start_ms) as t, count(*) as n from segments group by 1, 2)
select meeting, count(*) as speakers, sum(t)::bigint as time_ms, sum(n)::bigint as n_segments, round(avg(c), 6) as overall_confidence from m group by 1""")
def diarization_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = M.speaker_stats(views.segments(spark, sf_dir), "meeting")
    return own.groupBy("meeting").agg(F.count("*").alias("speakers"), F.sum("time_ms").alias("time_ms"), F.sum("n_segments").alias("n_segments"), F.round(F.avg("mean_confidence"), 6).alias("overall_confidence"))
