"""Domain tables derived from the driver's tables, as DataFrames and as SQL common table expressions.

Times are whole milliseconds, so both engines get the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import vector as V
from parley.session import table

SQL_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"

PROFILES = "profiles as (select distinct label::bigint as speaker_id, 'Speaker ' || label as name, label % 5 <> 4 as is_active from embeddings)"
VOICES = "voices as (select vec_id as id, label::bigint as speaker_id, embedding::double[] as vector, (50 + vec_id % 50) / 100.0::double as quality, (3 + vec_id % 8)::double as duration_s from embeddings)"
SEGMENTS = f"""
seg0 as (select conv_id as meeting, turn as seq, role as speaker, coalesce(text, '') as text, len({SQL_WORDS.format("coalesce(text, '')")})::bigint as n_words from conversations),
seg1 as (select *, coalesce(sum(400 * n_words + case when seq % 3 = 1 then -1500 else 500 end) over (partition by meeting order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms from seg0),
segments as (select *, start_ms + 400 * n_words as end_ms, (60 + (meeting * 7 + seq * 13) % 40) / 100.0::double as confidence from seg1)"""
PREDICTED = (
    SEGMENTS
    + """,
predicted as (select meeting, seq, case when (meeting + seq) % 9 <> 0 then speaker when speaker = 'user' then 'assistant' when speaker = 'assistant' then 'system' else 'user' end as speaker,
  greatest(0, start_ms + ((seq * 37) % 11 - 5) * 300)::bigint as start_ms, greatest(0, end_ms + ((seq * 37) % 11 - 5) * 300)::bigint as end_ms,
  (50 + (meeting * 11 + seq * 17) % 50) / 100.0::double as confidence from segments)"""
)
FRAMES = "frames as (select user_id as stream, event_id as seq, ts, epoch_us(ts) as t_us, value / 500 as energy from events)"
MEETINGS = "meetings as (select doc_id as id, coalesce(text, '') as title, lang as language, n_chars // 15 as duration_s, 1 + doc_id % 5 as speakers, (60 + doc_id % 41)::bigint as accuracy, case when doc_id % 3 = 0 then 'high' when doc_id % 3 = 1 then 'medium' else 'low' end as quality from documents)"


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice embeddings: id, speaker_id, vector, quality, duration_s."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("speaker_id"), V.doubles(F.col("embedding")).alias("vector"), ((50 + F.col("vec_id") % 50) / 100.0).alias("quality"), (3 + F.col("vec_id") % 8).cast("double").alias("duration_s"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker profiles: speaker_id, name, is_active."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("speaker_id")).distinct()
    return ids.select("speaker_id", F.concat(F.lit("Speaker "), F.col("speaker_id").cast("string")).alias("name"), (F.col("speaker_id") % 5 != 4).alias("is_active"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed, speaker-labelled segments: meeting, seq, speaker, text, n_words, start_ms, end_ms, confidence."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_words", F.size(X.words(F.col("text"))).cast("long"))
    before = W.partitionBy("meeting").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start_ms", F.coalesce(F.sum(400 * F.col("n_words") + F.when(F.col("seq") % 3 == 1, -1500).otherwise(500)).over(before), F.lit(0)).cast("long"))
    return rows.withColumn("end_ms", F.col("start_ms") + 400 * F.col("n_words")).withColumn("confidence", (60 + (F.col("meeting") * 7 + F.col("seq") * 13) % 40) / 100.0)


def predicted(own: DataFrame) -> DataFrame:
    """Segments as a recogniser might have them: shifted, some with the wrong speaker."""
    other = F.when((F.col("meeting") + F.col("seq")) % 9 != 0, F.col("speaker")).when(F.col("speaker") == "user", "assistant").when(F.col("speaker") == "assistant", "system").otherwise("user")
    shift = ((F.col("seq") * 37) % 11 - 5) * 300
    return own.select("meeting", "seq", other.alias("speaker"), F.greatest(F.lit(0), F.col("start_ms") + shift).alias("start_ms"), F.greatest(F.lit(0), F.col("end_ms") + shift).alias("end_ms"), ((50 + (F.col("meeting") * 11 + F.col("seq") * 17) % 50) / 100.0).alias("confidence"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy frames of streams: stream, seq, ts, t_us, energy."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), ts.alias("ts"), F.unix_micros(ts).alias("t_us"), (F.col("value") / 500).alias("energy"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meeting list: id, title, language, duration_s, speakers, accuracy, quality."""
    quality = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("title"), F.col("lang").alias("language"), F.floor(F.col("n_chars") / 15).alias("duration_s"), (1 + F.col("doc_id") % 5).alias("speakers"), (60 + F.col("doc_id") % 41).alias("accuracy"), quality.alias("quality"))


def timed(rows: DataFrame, order: str = "seq") -> DataFrame:
    """``rows`` with the time at which they are taken in, a minute of the year 2000 for each number: ``ts`` and ``t_us``."""
    return rows.withColumn("t_us", 946_684_800_000_000 + F.col(order) * 60_000_000).withColumn("ts", F.timestamp_micros("t_us"))
