"""Dashboards and lists over findings and scans.

An owner's rows are selected first, findings meet scans on scan_id, and every limit has a tie-break.
``severity_order`` is ``enum_desc`` (declaration order backwards: INFO first) or ``risk_desc``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.catalogs import dims
from rulestream.operators.findings import severity_score

OWNED = ("completed", "running", "queued")


def severity_key(order: str = "enum_desc") -> Column:
    """What to sort by, descending."""
    if order == "risk_desc":
        return severity_score(F.col("severity"))
    return F.element_at(F.create_map(*(F.lit(v) for s in dims.SEVERITIES for v in (s[0], s[2]))), F.col("severity"))


def _mine(scans: DataFrame, owner: int) -> DataFrame:
    return scans.where(F.col("created_by_id") == owner)


def owned_findings(findings: DataFrame, scans: DataFrame, owner: int) -> DataFrame:
    """Findings of the owner's scans, with the scan's name."""
    return findings.join(_mine(scans, owner).select("scan_id", F.col("name").alias("scan_name")), "scan_id")


def scan_totals(scans: DataFrame, owner: int, as_of: str, days: int = 7) -> DataFrame:
    """One row: total, active and recent scans, and the mean risk of the completed ones, in one pass."""
    recent = F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    mean = F.avg(F.when(F.col("status") == "completed", F.col("risk_score")).cast("double"))
    return _mine(scans, owner).agg(
        F.count(F.lit(1)).alias("total_scans"), F.count_if(F.col("status") == "running").alias("active_scans"), F.count_if(recent).alias("recent_scans_7d"),
        F.bround(F.coalesce(mean, F.lit(0.0)), 1).alias("risk_score"),
    )


def _zero_filled(spark_df: DataFrame, key: str, values: list, counted: DataFrame) -> DataFrame:
    known = spark_df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return F.broadcast(known).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def severity_distribution(findings: DataFrame, scans: DataFrame, owner: int) -> DataFrame:
    """(severity, n) of findings that aren't false positives; all five severities."""
    counted = owned_findings(findings, scans, owner).where(~F.col("is_false_positive")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return _zero_filled(findings, "severity", list(dims.SEVERITY_NAMES), counted)


def owasp_rollup(findings: DataFrame, scans: DataFrame, owner: int) -> DataFrame:
    """(owasp, n): 21 categories rolled up into seven labels, zero-filled."""
    label = F.element_at(F.create_map(*(F.lit(v) for kv in dims.CATEGORIES for v in kv)), F.col("category"))
    counted = owned_findings(findings, scans, owner).where(~F.col("is_false_positive")).groupBy(label.alias("owasp")).agg(F.count(F.lit(1)).alias("n"))
    return _zero_filled(findings, "owasp", sorted({x for _, x in dims.CATEGORIES}), counted)


def summary(findings: DataFrame, scans: DataFrame, owner: int, as_of: str) -> DataFrame:
    """The whole dashboard head as one row: two aggregations instead of thirty queries."""
    mine = owned_findings(findings, scans, owner).where(~F.col("is_false_positive"))
    label = F.element_at(F.create_map(*(F.lit(v) for kv in dims.CATEGORIES for v in kv)), F.col("category"))
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in dims.SEVERITY_NAMES]
    counts += [F.count_if(label == x).alias("owasp_" + x.split(":")[0].lower()) for x in sorted({x for _, x in dims.CATEGORIES})]
    one = mine.agg(F.count(F.lit(1)).alias("total_findings"), *counts).withColumn("_k", F.lit(1))
    return scan_totals(scans, owner, as_of).withColumn("_k", F.lit(1)).join(one, "_k").drop("_k")


def trends(findings: DataFrame, scans: DataFrame, owner: int, as_of: str, days: int = 30) -> DataFrame:
    """(date, critical .. info): findings a day since ``days`` before ``as_of``; false positives count too."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    mine = owned_findings(findings, scans, owner).where(F.col("created_at") >= since)
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in dims.SEVERITY_NAMES]
    return mine.groupBy(F.to_date("created_at").alias("date")).agg(*counts).orderBy("date")


def top_findings(findings: DataFrame, scans: DataFrame, owner: int, n: int = 10, severity_order: str = "enum_desc") -> DataFrame:
    """Open findings that aren't false positives; by severity, then CVSS with missing scores first."""
    mine = owned_findings(findings, scans, owner).where((F.col("status") == "open") & ~F.col("is_false_positive"))
    return mine.orderBy(severity_key(severity_order).desc(), F.col("cvss_score").desc_nulls_first(), "finding_id").limit(n)


def cwe_breakdown(findings: DataFrame, scans: DataFrame, owner: int, n: int = 20) -> DataFrame:
    """(cwe_id, name, n) of the most frequent weaknesses; the id stands in for a missing name."""
    mine = owned_findings(findings, scans, owner).where(F.col("cwe_id").isNotNull() & ~F.col("is_false_positive"))
    counted = mine.groupBy("cwe_id", "cwe_name").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "cwe_id", "cwe_name").limit(n).select("cwe_id", F.coalesce("cwe_name", "cwe_id").alias("name"), "n")


def list_scans(scans: DataFrame, owner: int, status: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """The owner's scans, newest first; an unknown status filters nothing."""
    mine = _mine(scans, owner)
    if status in ("pending", "queued", "running", "completed", "failed", "cancelled"):
        mine = mine.where(F.col("status") == status)
    return mine.orderBy(F.col("created_at").desc(), "scan_id").offset(offset).limit(limit)


def list_findings(findings: DataFrame, scan_id: int, severity: str | None = None, category: str | None = None, status: str | None = None, offset: int = 0, limit: int = 50, severity_order: str = "enum_desc") -> DataFrame:
    """Findings of one scan, false positives too; unknown filter values filter nothing."""
    from rulestream.operators.triage import STATUSES

    found = findings.where(F.col("scan_id") == scan_id)
    if severity and severity.upper() in dims.SEVERITY_NAMES:
        found = found.where(F.col("severity") == severity.upper())
    if category in dict(dims.CATEGORIES):
        found = found.where(F.col("category") == category)
    if status in STATUSES:
        found = found.where(F.col("status") == status)
    return found.orderBy(severity_key(severity_order).desc(), "finding_id").offset(offset).limit(limit)


def lookup(rows: DataFrame, key: str, value: int) -> DataFrame:
    """The row with an id; none if there is no such id."""
    return rows.where(F.col(key) == value)


def taken(users: DataFrame, email: str, username: str) -> DataFrame:
    """Users who have this address or this name."""
    return users.where(reduce(or_, (F.col("email") == email, F.col("username") == username)))


def at_least(users: DataFrame, role: str) -> DataFrame:
    """Users whose role has at least the level of ``role``."""
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in dims.ROLE_LEVELS.items() for v in kv)), F.col("role")), F.lit(0))
    return users.where(level >= dims.ROLE_LEVELS[role])
