"""Progress of scans as a stream, scanning of arriving files, and watermarked trends.

The latest state of each scan is what the progress feed shows; the windowed trend and the
sessions are extensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulestream.catalogs import dims


def phase_of(progress: Column) -> Column:
    """The phase that a progress value lies in: the last one that began."""
    out = F.lit(None).cast("string")
    for at, name in dims.PHASES:
        out = F.when(progress >= at, name).otherwise(out)
    return out


def newest(events: DataFrame) -> DataFrame:
    """(scan_id, ts, seq, status, phase, progress, findings): the newest event of each scan."""
    fields = ("ts", "seq", "status", "phase", "progress", "findings")
    return events.groupBy("scan_id").agg(F.max_by(F.struct(*fields), F.struct("ts", "seq")).alias("s")).select("scan_id", "s.*")


def latest(events: DataFrame) -> DataFrame:
    """``newest``, with ``done`` for states that are final."""
    return newest(events).drop("seq").withColumn("done", F.col("status").isin(*dims.FINAL))


def read_progress(spark: SparkSession, folder: str, schema: str = "scan_id bigint, ts timestamp, seq bigint, status string, phase string, progress int, findings int") -> DataFrame:
    """Progress events from files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def follow(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the newest event of each scan in each batch; no state is held, and a batch that is run again replaces its own output."""

    def run(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of each scan over all batches so far."""
    return latest(spark.read.parquet(folder))


def scan_arrivals(files: DataFrame, scan: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Scan files as they arrive; a batch that is run again replaces its own output."""

    def run(batch: DataFrame, number: int) -> None:
        scan(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_trend(findings: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Extension: findings by severity in windows of event time, with a bound on lateness."""
    return findings.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("w"), "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "severity", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: bursts of a scan's events, apart by at least ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("scan_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("scan_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
