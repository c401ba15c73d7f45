"""Enrichment of the worst findings by an outside provider, and what to make of its replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulestream.catalogs import dims
from rulestream.functions.text import let

BUDGET = {"deep": (75, 10), "bug_bounty": (50, 20)}
REPLY = "is_valid boolean, confidence double, exploitability string, cvss_score double, cvss_vector string, attack_scenario string, proof_of_concept string, business_impact string, remediation string, secure_code_example string, references array<string>, bug_bounty_title string, estimated_bounty string, false_positive_reason string"


def severity_score(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for s in dims.SEVERITIES for v in (s[0], s[1]))), severity), F.lit(0))


def eligible(findings: DataFrame, profile: str, scan_key: str | None = "scan_id") -> DataFrame:
    """``findings`` with ``asked``: the first few severe enough of each scan (of all, without a scan's key), by ``seq``, which names a finding in its scan.

    The few are ranked from severe findings alone, with the limit taken in each task before the shuffle. Of a scan only the
    last one's ``seq`` is joined back, and only if it has enough of them, so that no table of all asked ones is made.
    """
    least, budget = BUDGET[profile]
    if not scan_key:
        severe = findings.where(severity_score(F.col("severity")) >= least).select("seq")
        few = F.broadcast(severe.orderBy("seq").limit(budget)).withColumn("asked", F.lit(True))
        return findings.join(few, ["seq"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    severe = (severity_score(F.col("severity")) >= least) & F.col("seq").isNotNull()
    nth = F.row_number().over(Window.partitionBy("_scan").orderBy("_last"))
    last = findings.where(severe).select(F.col(scan_key).alias("_scan"), F.col("seq").alias("_last")).withColumn("_n", nth).where(F.col("_n") == budget).drop("_n")
    placed = findings.join(last, findings[scan_key].eqNullSafe(last["_scan"]), "left")
    return placed.withColumn("asked", severe & (F.col("_last").isNull() | (F.col("seq") <= F.col("_last")))).drop("_scan", "_last")


def read_reply(raw: Column) -> Column:
    """The JSON object of a reply: of the whole text, else of a fenced block, else between the outermost braces."""
    as_json = lambda t: F.from_json(t, F.lit(REPLY), {"mode": "PERMISSIVE"})
    valid = lambda t: F.when(F.startswith(F.btrim(t), F.lit("{")) & F.json_object_keys(t).isNotNull(), as_json(t))
    tries = [raw, F.regexp_extract(raw, r"```(?:json)?\s*([\s\S]+?)\s*```", 1), F.regexp_extract(raw, r"\{[\s\S]+\}", 0)]
    return F.coalesce(*(let(t, valid) for t in tries))


def overlay(raw: Column, failed: Column) -> Column:
    """A reply, read once, with the defaults filled in: confidence 0.4 where it can't be read, 0.5 where the call failed, 0.7 where it says none."""
    texts = ("cvss_vector", "attack_scenario", "proof_of_concept", "business_impact", "remediation", "secure_code_example", "bug_bounty_title", "estimated_bounty", "false_positive_reason")

    def filled(said: Column) -> Column:
        fill = lambda name, value: F.coalesce(said[name], F.lit(value)).alias(name)
        unread = F.when(failed, 0.5).otherwise(0.4)
        return F.struct(
            fill("is_valid", True), F.when(failed | said.isNull(), unread).otherwise(F.coalesce(said["confidence"], F.lit(0.7))).alias("confidence"),
            fill("exploitability", "MEDIUM"), fill("cvss_score", 0.0), *(fill(t, "") for t in texts), F.coalesce(said["references"], F.array().cast("array<string>")).alias("references"),
        )

    return let(read_reply(raw), filled)


def offline(_: str) -> str:
    """The provider without a model: an empty reply."""
    return ""


def ask(findings: DataFrame, provider: Callable[[str], str] = offline) -> DataFrame:
    """``findings`` with ``raw`` and ``failed`` for the rows asked about; the provider is called in batches on the executors.

    A call may cost something and say another thing the next time, so no plan may make it twice.
    """
    prompt = F.to_json(F.struct("title", "category", "file_path", "snippet", "source", "sink"))

    @F.pandas_udf("raw string, failed boolean")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part:
                try:
                    rows.append((None if text is None else provider(text), False))
                except Exception:  # a failed call is a result of its own
                    rows.append((None, True))
            yield pd.DataFrame(rows, columns=["raw", "failed"])

    call = call.asNondeterministic()
    return findings.withColumn("_r", call(F.when(F.col("asked"), prompt))).withColumns({"raw": F.col("_r.raw"), "failed": F.col("_r.failed")}).drop("_r")


def enrich(findings: DataFrame, profile: str, provider: Callable[[str], str] | None = offline, scan_key: str | None = "scan_id") -> DataFrame:
    """Findings with what the provider says; those it calls invalid are dropped. Without a provider nothing changes."""
    if provider is None:
        return findings.withColumn("ai_analyzed", F.lit(False))
    asked = ask(eligible(findings, profile, scan_key), provider)
    said = F.when(F.col("asked"), overlay(F.coalesce("raw", F.lit("")), F.col("failed")))
    # one row or none of each: a filter would read the reply again
    kept = asked.select("*", F.explode(F.filter(F.array(said), lambda o: ~F.col("asked") | o["is_valid"])).alias("_o"))
    take = lambda name, old: F.when(F.col("asked"), F.col(f"_o.{name}")).otherwise(old)
    fields = {"ai_analyzed": F.col("asked"), "confidence": take("confidence", F.col("confidence")), "exploitability": take("exploitability", F.lit(None).cast("string")), "cvss_score": take("cvss_score", F.lit(None).cast("double"))}
    fields |= {n: take(n, F.lit(None).cast("string")) for n in ("cvss_vector", "attack_scenario", "proof_of_concept", "business_impact", "remediation", "secure_code_example")}
    fields["references"] = take("references", F.array().cast("array<string>"))
    if profile == "bug_bounty":
        fields |= {n: take(n, F.lit(None).cast("string")) for n in ("bug_bounty_title", "estimated_bounty")}
    return kept.withColumns(fields).drop("_o", "raw", "failed", "asked")
