"""Secrets in lines: patterns whose value, where asked for, must be random enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.catalogs.secrets import CONFIDENCE, CWE, SECRETS
from rulestream.functions.text import entropy, java, snippet
from rulestream.operators.rows import explode_findings, finding


def _found(text: Column, number: int) -> Column:
    """array<struct<ord, k, value>> of a pattern's values in a line."""
    _, _, least, pattern = SECRETS[number]
    values = F.transform(F.regexp_extract_all(text, F.lit(java(pattern, many_lines=False)), F.lit(1)), lambda v, k: F.struct(F.lit(number).alias("ord"), k.alias("k"), v.alias("value")))
    return F.filter(values, lambda v: entropy(v["value"]) >= least) if least else values


def secret_rows(lines: Column) -> Column:
    """A file's secrets as findings; the value itself stays out of the title."""
    names, severities = (F.array(*(F.lit(s[i]) for s in SECRETS)) for i in (0, 1))
    # one pattern thins the lines out before each is tried
    some = java("|".join(f"(?:{p})" for *_, p in SECRETS), many_lines=False)
    rows = F.filter(F.transform(lines, lambda t, i: F.struct((i + 1).alias("n"), t.alias("t"))), lambda r: r["t"].rlike(some))

    def one(r: Column, h: Column) -> Column:
        name = F.get(names, h["ord"])
        return finding(
            stage_ord=1, rule_id=name, title=F.concat(F.lit("Secret in source: "), name), category="secret", severity=F.get(severities, h["ord"]), line_start=r["n"], line_end=r["n"], snippet=snippet(lines, r["n"], r["n"]),
            cwe_id=CWE, owasp="A02:2021", confidence=CONFIDENCE, method="secret_detection", source=F.left(F.btrim(r["t"]), F.lit(300)), ord_a=h["ord"], ord_b=h["k"],
        )

    return F.flatten(F.transform(rows, lambda r: F.transform(F.flatten(F.array(*(_found(r["t"], i) for i in range(len(SECRETS))))), lambda h: one(r, h))))


def secret_findings(files: DataFrame) -> DataFrame:
    """Secrets as findings."""
    return explode_findings(files, secret_rows)
