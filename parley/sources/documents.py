"""JSON ground truth, utterance transcripts, meeting lists; transcript files written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = """recording_id string, audio_file string, duration double, sample_rate int, total_speakers int, metadata map<string,string>,
segments array<struct<speaker_id:string,start_time:double,end_time:double,text:string,audio_file:string,quality:double,confidence:double>>"""
MEETING = "array<struct<id:string,title:string,date:string,duration:long,speakers:int,accuracy:double,language:string,quality:string,preview:string>>"


def read_truth(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Segments of all recordings under ``path``: recording, seq, speaker, start_ms, end_ms, text, confidence, file.

    Both layouts are read: recordings named by ``recording_id`` or by ``audio_file``.
    """
    docs = spark.read.schema(TRUTH).option("multiLine", multi_line).json(path)
    each = docs.select(F.coalesce("recording_id", "audio_file").alias("recording"), F.col("_metadata.file_path").alias("file"), F.posexplode("segments").alias("seq", "s"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return each.select("recording", F.col("seq").cast("long").alias("seq"), F.col("s.speaker_id").alias("speaker"), ms("s.start_time").alias("start_ms"), ms("s.end_time").alias("end_ms"), F.col("s.text").alias("text"), F.coalesce("s.confidence", "s.quality", F.lit(1.0)).alias("confidence"), "file")


def truth_json(segments: DataFrame, key: str = "recording") -> DataFrame:
    """One JSON text for each recording, as ``read_truth`` reads it."""
    second = lambda c: (F.col(c) / 1000).alias("start_time" if c == "start_ms" else "end_time")
    own = F.struct(F.col("seq"), F.struct(F.col("speaker").alias("speaker_id"), second("start_ms"), second("end_ms"), "text", "confidence").alias("s"))
    lists = segments.groupBy(F.col(key).alias("recording_id")).agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["s"]).alias("segments"))
    return lists.select("recording_id", F.to_json(F.struct("recording_id", "segments")).alias("json"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of ``*.trans.txt`` files: utt_id, speaker, chapter, number, text."""
    lines = spark.read.option("pathGlobFilter", "*.trans.txt").option("recursiveFileLookup", "true").text(path).where("trim(value) <> ''")
    parts, ids = F.split("value", " ", 2), F.split("utt_id", "-")
    rows = lines.select(parts[0].alias("utt_id"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("text"))
    return rows.select("utt_id", F.try_element_at(ids, F.lit(1)).alias("speaker"), F.try_element_at(ids, F.lit(2)).alias("chapter"), F.try_element_at(ids, F.lit(3)).alias("number"), "text")


def meeting_rows(lists: DataFrame, *columns: str) -> DataFrame:
    """Meetings of several columns of JSON lists, one after the other, with real dates."""
    out = None
    for c in columns:
        own = lists.select(F.explode(F.from_json(c, MEETING)).alias("m")).select("m.*").withColumn("date", F.try_to_timestamp("date"))
        out = own if out is None else out.unionByName(own)
    return out


def stamp(ms: Column, mark: str) -> Column:
    """hh:mm:ss and milliseconds after ``mark``."""
    s = F.floor(ms / 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)), F.pmod(ms, F.lit(1000)))


def captions(segments: DataFrame, style: str = "srt", key: str = "meeting") -> DataFrame:
    """One caption text (``srt``, ``vtt`` or ``txt``) for each meeting."""
    mark = "," if style == "srt" else "."
    times = F.concat(stamp(F.col("start_ms"), mark), F.lit(" --> "), stamp(F.col("end_ms"), mark))
    said = F.concat_ws(": ", "speaker", "text")
    lists = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_ms", "seq", times.alias("t"), said.alias("s")))).alias("c"))
    if style == "txt":
        return lists.select(key, F.array_join(F.transform("c", lambda x: x["s"]), "\n").alias("body"))
    number = (lambda i: F.concat((i + 1).cast("string"), F.lit("\n"))) if style == "srt" else (lambda i: F.lit(""))
    body = F.array_join(F.transform("c", lambda x, i: F.concat(number(i), x["t"], F.lit("\n"), x["s"], F.lit("\n"))), "\n")
    return lists.select(key, body.alias("body") if style == "srt" else F.concat(F.lit("WEBVTT\n\n"), body).alias("body"))
