"""Structured Streaming queries over energy frames and utterances that need no state of our own (see ``live``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def framed(events: DataFrame, length: str, hop: str | None = None, late: str = "5 seconds", key: str = "stream") -> DataFrame:
    """Tumbling or sliding windows of frames: n, mean and peak energy. Rows later than ``late`` are rejected."""
    when = F.window("ts", length, hop) if hop else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(key, when.alias("w")).agg(F.count("*").alias("n"), F.avg("energy").alias("mean"), F.max("energy").alias("peak"))


def session_windows(events: DataFrame, gap: str, late: str = "5 seconds", key: str = "stream") -> DataFrame:
    """Sessions of frames that are less than ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("energy").alias("peak"))


def first_seen(events: DataFrame, *columns: str, late: str = "1 hour") -> DataFrame:
    """Each combination of ``columns`` once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(columns))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there as a stream into Parquet files, and stop."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table as a stream of files, replayed in one trigger.

    Files of a table are in no order of event time, so what a trigger leaves out could come too late
    for the watermark, or out of order for a fold, in the next one.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def emit(stream: DataFrame, out: str, checkpoint: str, kinds: dict[str, Column]) -> None:
    """Events of a stream as rows of ``event`` and JSON ``payload``, one set for each kind, written batch by batch.

    A batch is written under its number, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = [batch.where(hit).select(F.lit(name).alias("event"), F.to_json(F.struct(*batch.columns)).alias("payload")) for name, hit in kinds.items()]
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        every.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
