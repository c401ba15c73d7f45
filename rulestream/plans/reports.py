"""What the dashboards and report pages make of findings: bands, estimates, filters, reports, SARIF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.catalogs import dims
from rulestream.functions.text import base_name

TOOL = "rulestream"


def pie(distribution: DataFrame) -> DataFrame:
    """Severities that occur."""
    return distribution.where("n > 0")


def merged_low(trend: DataFrame) -> DataFrame:
    """Trend rows with LOW and INFO as one."""
    return trend.withColumn("low_info", F.col("low") + F.col("info")).drop("low", "info")


def risk_band(score: Column) -> Column:
    return F.when(score > 70, "high").when(score > 40, "medium").otherwise("low")


def cvss_band(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").otherwise("other")


def labelled(findings: DataFrame) -> DataFrame:
    """Findings with their file's base name and CVSS band."""
    return findings.withColumns({"file_name": base_name(F.col("file_path")), "cvss_band": cvss_band(F.col("cvss_score"))})


def _per_severity(i: int, cast: str = "double") -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for s in dims.SEVERITIES for v in (s[0], s[i]))), F.col("severity")).cast(cast)


def potential_bounty(top: DataFrame) -> DataFrame:
    """(potential): the sum of the middles of the ranges."""
    return top.agg(F.coalesce(F.sum((_per_severity(4) + _per_severity(5)) / 2), F.lit(0.0)).alias("potential"))


def radar(distribution: DataFrame) -> DataFrame:
    """(subject, value): six axes from the severity counts, at most 100."""
    n = {s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)) for s in dims.SEVERITY_NAMES}
    axes = {"Injection": (n["CRITICAL"] + n["HIGH"]) * 10, "Auth": n["HIGH"] * 8, "Access Ctrl": n["CRITICAL"] * 12, "Crypto": n["MEDIUM"] * 5, "Config": n["LOW"] * 3, "Data Exposure": n["MEDIUM"] * 6}
    row = distribution.agg(*(F.least(F.lit(100), v).cast("bigint").alias(f"a{i}") for i, v in enumerate(axes.values())))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("subject"), F.col(f"a{i}").alias("value")) for i, k in enumerate(axes)))).alias("x")).select("x.*")


def bounty_range(findings: DataFrame) -> DataFrame:
    """Findings with the range of what they may earn; none for INFO."""
    text = F.concat(F.lit("$"), _per_severity(4, "int").cast("string"), F.lit(" - $"), _per_severity(5, "int").cast("string"))
    return findings.withColumn("bounty_range", F.when(_per_severity(5) > 0, text))


def matching(findings: DataFrame, severities: list[str] | None = None, category: str | None = None) -> DataFrame:
    """Findings of the chosen severities (none chosen: all) and category."""
    if severities:
        findings = findings.where(F.col("severity").isin(*severities))
    return findings.where(F.col("category") == category) if category else findings


def completed_among_newest(scans: DataFrame, n: int = 30) -> DataFrame:
    """The completed ones among the newest scans: the limit comes before the filter."""
    return scans.orderBy(F.col("created_at").desc(), "scan_id").limit(n).where(F.col("status") == "completed")


def _or(column: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(other))


def _joined(rows: DataFrame, text: Column, order: list[str], by: list[str], between: str) -> DataFrame:
    """The texts of each group in order. A report holds a group's findings, so groups are single scans."""
    made = rows.select(*by, F.struct(*order).alias("_o"), text.alias("_t"))
    return made.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), between).alias("body"), F.count(F.lit(1)).alias("n"))


def submission_report(findings: DataFrame, by: str = "scan_id", order: str = "seq", most: int = 10) -> DataFrame:
    """(scan, report) with the first few findings in full; sections without content are left out."""
    part = lambda name, column: F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) != "", F.concat(F.lit(f"\n### {name}\n"), F.col(column).cast("string"), F.lit("\n"))).otherwise("") if column in findings.columns else F.lit("")
    text = F.concat(
        F.lit("## "), F.col(order).cast("string"), F.lit(". "), F.col("title"), F.lit("\n\nSeverity: "), "severity", F.lit(" | CWE: "), _or("cwe_id", "N/A"), F.lit(" | OWASP: "), _or("owasp_category", "N/A"),
        F.lit("\n\nFile: "), "file_path", F.lit("\nLine: "), F.col("line_start").cast("string"), F.lit("\nDetection: "), "detection_method", F.lit("\n"),
        part("Attack scenario", "attack_scenario"), part("Proof of concept", "proof_of_concept"), part("Remediation", "ai_remediation"), part("Estimated bounty", "estimated_bounty"),
    )
    shown = _joined(findings.where(F.col(order) <= most), text, [order], [by], "\n---\n").drop("n")
    totals = findings.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return totals.join(shown, by, "left").select(by, F.concat(F.lit("# Security report\n\nTotal findings: "), F.col("n").cast("string"), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("report"))


def executive_report(counts: DataFrame, by: str = "scan_id") -> DataFrame:
    """(scan, report) from rows with the severity counts and the risk score."""
    verdict = F.when(F.col("critical") > 0, "Critical risk: fix before any deployment.").otherwise("Risk is manageable: fix high findings first.")
    line = lambda name, c, what: F.concat(F.lit(f"| {name} | "), F.col(c).cast("string"), F.lit(f" | {what} |\n"))
    text = F.concat(
        F.lit("# Executive summary\n\nRisk score: "), F.col("risk_score").cast("string"), F.lit("/100\n\n| Severity | Count | Due |\n|---|---|---|\n"),
        line("Critical", "critical", "at once"), line("High", "high", "7 days"), line("Medium", "medium", "30 days"), line("Low", "low", "best effort"), F.lit("\n"), verdict,
    )
    return counts.select(by, text.alias("report"))


def developer_guide(findings: DataFrame, by: str = "scan_id", order: str = "seq") -> DataFrame:
    """(scan, report) with where each finding is and how to fix it."""
    fix = _or("ai_remediation", "Apply security best practices") if "ai_remediation" in findings.columns else F.lit("Apply security best practices")
    text = F.concat(F.lit("## "), "title", F.lit("\nFile: "), "file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("\nFix: "), fix)
    return _joined(findings, text, [order], [by], "\n\n---\n\n").select(by, F.concat(F.lit("# Developer guide\n\n"), F.col("body")).alias("report"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", "error").when(severity == "HIGH", "warning").otherwise("note")


def sarif_results(findings: DataFrame, by: str = "scan_id", order: str = "seq") -> DataFrame:
    """(scan, seq, rule_id, level, message, uri, start_line): the result rows of the SARIF log."""
    return findings.select(by, order, _or("cwe_id", "UNKNOWN").alias("rule_id"), sarif_level(F.col("severity")).alias("level"), F.col("title").alias("message"), F.col("file_path").alias("uri"), F.col("line_start").alias("start_line"))


def sarif(findings: DataFrame, by: str = "scan_id", order: str = "seq") -> DataFrame:
    """(scan, sarif): a SARIF 2.1.0 log of each scan."""
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.struct(F.col("message").alias("text")).alias("message"), F.col("level").alias("level"), F.array(place).alias("locations"))
    rows = sarif_results(findings, by, order).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), result.alias("r")))), lambda x: x["r"]).alias("results"))
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit("1.0.0").alias("version"), F.array().cast("array<string>").alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results").alias("results"))
    return rows.select(by, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))
