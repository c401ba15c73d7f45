"""Changes to findings and scans as append-only logs, of which the latest entry of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("open", "confirmed", "false_positive", "accepted_risk", "fixed", "in_review")


def checked(log: DataFrame) -> DataFrame:
    """Entries that may be applied: a known status, or none."""
    return log.where(F.col("status").isNull() | F.col("status").isin(*STATUSES))


def apply_triage(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings after the log's entries (finding_id, ts, seq, status, is_false_positive, reason).

    Each field takes its latest value that was set. Marking a false positive forces that status at
    that moment; taking the mark back doesn't restore the old one.
    """
    entries = checked(log).withColumn("_status", F.when(F.col("is_false_positive"), F.lit("false_positive")).otherwise(F.col("status")))
    at = F.struct("ts", "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    latest = entries.groupBy("finding_id").agg(last("_status").alias("_s"), last("is_false_positive").alias("_f"), last("reason").alias("reason"))
    joined = findings.join(latest, "finding_id", "left")
    return joined.withColumns({"status": F.coalesce("_s", "status"), "is_false_positive": F.coalesce("_f", "is_false_positive")}).drop("_s", "_f")


def cancel(scans: DataFrame, requests: DataFrame, final: tuple[str, ...] = ("completed", "failed", "cancelled")) -> DataFrame:
    """Scans after cancel requests (scan_id, user_id): an owner's request cancels, others change nothing."""
    asked = requests.select("scan_id", F.col("user_id").alias("created_by_id")).distinct().withColumn("_c", F.lit(True))
    joined = scans.join(asked, ["scan_id", "created_by_id"], "left")
    return joined.withColumn("status", F.when(F.col("_c"), F.lit("cancelled")).otherwise(F.col("status"))).drop("_c")
