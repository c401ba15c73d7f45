"""Where findings and reports go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulestream.catalogs import dims
from rulestream.functions.text import relative_path
from rulestream.operators.findings import severity_counts

MOST_TITLE, MOST_SNIPPET = 500, 2000
MOST_SCANS = 1000


def stored(findings: DataFrame, base: str = "") -> DataFrame:
    """Findings as they are stored: known categories and severities, capped texts, relative paths, status open."""
    known = [c for c, _ in dims.CATEGORIES if c not in dims.UNWRITTEN]
    return findings.withColumns(
        {
            "title": F.left("title", F.lit(MOST_TITLE)),
            "snippet": F.left("snippet", F.lit(MOST_SNIPPET)),
            "category": F.when(F.col("category").isin(*known), F.col("category")).otherwise("other"),
            "severity": F.when(F.col("severity").isin(*dims.SEVERITY_NAMES), F.col("severity")).otherwise("MEDIUM"),
            "file_path": relative_path(F.col("file_path"), F.lit(base)) if base else F.col("file_path"),
            "status": F.lit("open"),
        }
    )


def write_findings(findings: DataFrame, folder: str, base: str = "") -> None:
    """Append to the findings table, partitioned by scan; a task writes few files even with many scans, and a large scan takes several."""
    stored(findings, base).hint("rebalance", "scan_id").write.mode("append").partitionBy("scan_id").parquet(folder)


def read_findings(spark: SparkSession, folder: str, scan_id: int | None = None) -> DataFrame:
    """Stored findings; with a scan only its partition is read."""
    rows = spark.read.parquet(folder)
    return rows if scan_id is None else rows.where(F.col("scan_id") == scan_id)


def write_reports(reports: DataFrame, folder: str, column: str = "report", by: str = "scan_id", json: bool = False) -> None:
    """One text file or more for each scan; as JSON, an object with the report and whatever other columns there are."""
    text = F.to_json(F.struct(*(c for c in reports.columns if c != by))) if json else F.col(column)
    reports.select(by, text.alias("value")).write.mode("overwrite").partitionBy(by).text(folder)


def finished_scans(findings: DataFrame) -> DataFrame:
    """(scan_id, status, phase, progress, total_findings, the five counts, risk_score): the last row of each scan for its log, of which the latest entry counts."""
    return severity_counts(findings, ["scan_id"]).withColumnRenamed("total", "total_findings").withColumns({"status": F.lit("completed"), "phase": F.lit("complete"), "progress": F.lit(100)})


def write_scan(findings: DataFrame, folder: str, log: str, base: str = "") -> None:
    """Append findings, then what they add up to, read back from where they were written: a scan is complete only after its findings are there."""
    spark = findings.sparkSession
    scans = [r["scan_id"] for r in findings.select("scan_id").distinct().limit(MOST_SCANS + 1).collect()]
    if len(scans) > MOST_SCANS:
        raise ValueError(f"more than {MOST_SCANS} scans at once: write findings and log apart")
    write_findings(findings, folder, base)
    written = spark.read.parquet(folder).where(F.col("scan_id").isin(scans))
    finished_scans(written).write.mode("append").parquet(log)
