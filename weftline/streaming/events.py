"""Job events from log lines, in batch or as a stream, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event string, fields map<string,string>"


def parse_lines(lines: DataFrame, prefix: str = "JOB_EVENT ", strict: bool = False) -> DataFrame:
    """event, fields of each line (column value): the JSON after the prefix, or a JSON line.

    Lines that hold neither are dropped, or an error with ``strict``. Works on streams.
    """
    at = F.instr(F.col("value"), prefix)
    payload = F.when(at > 0, F.substr(F.col("value"), at + F.lit(len(prefix)))).otherwise(F.col("value"))
    got = lines.withColumn("e", F.from_json(payload, EVENT))
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a job event: "), F.col("value")))
        return got.select(F.when(F.col("e.event").isNull(), bad).otherwise(F.col("e.event")).alias("event"), "e.fields")
    return got.where("e.event is not null").select("e.event", "e.fields")


def summary(events: DataFrame, ordinal: str) -> DataFrame:
    """Per event kind: how many, and the fields of the last by ordinal."""
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.max_by("fields", ordinal).alias("last"))


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return parse_lines(spark.readStream.text(folder))


def tumbling_counts(events: DataFrame, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Events by type in windows of ``ts``, with a watermark; an extension, batch or stream."""
    w = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "event_type", "n"
    )
