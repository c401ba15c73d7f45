"""Findings of all engines: union, first-wins dedup, counts, risk, order, profiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.catalogs import dims
from rulestream.functions.text import fingerprint
from rulestream.operators.context import context_rows
from rulestream.operators.dependencies import advisory_findings, dependency_rows
from rulestream.operators.enrich import BUDGET, enrich, offline, severity_score
from rulestream.operators.rows import explode_findings
from rulestream.operators.rules import rule_rows
from rulestream.operators.secrets import secret_rows
from rulestream.operators.taint import taint_rows

PROFILES = ("quick", "standard", "deep", "bug_bounty")
#: Order of the engines over a directory, and over a single text.
DIRECTORY, SINGLE = (1, 2, 3, 4, 5), (1, 5, 2, 3, 4)


def union(parts: list[DataFrame]) -> DataFrame:
    """All findings as a bag, with the order of flows where an engine has one."""
    with_order = [p if "flow_ord" in p.columns else p.withColumn("flow_ord", F.lit("")) for p in parts]
    return reduce(DataFrame.unionByName, with_order)


#: The order in which engines, files and rules report.
REPORTED = ("stage_ord", "file_path", "ord_a", "ord_b", "flow_ord", "line_end", "title")


def dedup(findings: DataFrame) -> DataFrame:
    """The first finding of each rule, file and line, in the order in which they are reported; each task keeps its own first ones before the shuffle."""
    named = findings.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_start")))
    first = F.min_by(F.struct(*(c for c in named.columns if c != "fingerprint")), F.struct(*REPORTED))
    return named.groupBy("fingerprint").agg(first.alias("f")).select("f.*", "fingerprint")


def severity_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """One row for each key: the five counts, their total and the risk score."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in dims.SEVERITY_NAMES]
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts).withColumn("risk_score", risk_score())


def risk_score() -> Column:
    return F.least(F.lit(100), sum((F.col(s[0].lower()) * s[3] for s in dims.SEVERITIES), F.lit(0))).cast("int")


def ranked(findings: DataFrame) -> DataFrame:
    """Worst first; findings of one severity stay in the order in which they were reported."""
    return findings.orderBy(severity_score(F.col("severity")).desc(), "stage_ord", "file_path", "ord_a", "ord_b", "flow_ord", "line_start")


def scan(files: DataFrame, profile: str = "standard", advisories: DataFrame | None = None, single: bool = False, provider: Callable[[str], str] | None = offline) -> DataFrame:
    """The deduplicated findings of a scan, from one pass over the files, and one over manifests if there are ``advisories``.

    The quick profile has secrets and dependencies only, except for a single text. The deep and the
    bug-bounty profile ask ``provider`` about the first few severe findings: after the dedup, or
    before it for a single text. Without a provider they find what the standard profile does.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    engines = [secret_rows, dependency_rows]
    if profile != "quick" or single:
        engines += [rule_rows, taint_rows, context_rows]
    found = explode_findings(files, *engines)
    if advisories is not None:
        found = found.unionByName(advisory_findings(files, advisories))
    if single:
        place = F.create_map(*(F.lit(v) for stage, at in zip(DIRECTORY, SINGLE) for v in (stage, at)))
        found = found.withColumn("stage_ord", F.element_at(place, F.col("stage_ord")))
    if profile not in BUDGET or provider is None:
        return dedup(found)
    told = lambda rows: enrich(rows.withColumn("seq", F.struct(*REPORTED)), profile, provider, None).drop("seq")
    return dedup(told(found)) if single else told(dedup(found))
