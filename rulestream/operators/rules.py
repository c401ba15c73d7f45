"""The pattern rules over whole files: one pass, no shuffle.

Each rule is a literal column expression, so its pattern is compiled once per task. A file's
matches of all rules are gathered in one array and exploded; context is read from the file's own
lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.catalogs.rules import RULES, Rule
from rulestream.functions.text import java, let, positions, snippet, split_lines
from rulestream.operators.rows import explode_findings, finding

COMMENT = r"^(?:#|//|\*|/\*|<!--|'''|\"\"\")"
CONTEXT = 3


def applies(rule: Rule, language: Column) -> Column:
    """A rule without languages is for every file, also for one of unknown language."""
    return F.coalesce(language.isin(*rule.languages), F.lit(False)) if rule.languages else F.lit(True)


def rules_for(language: str | None = None, category: str | None = None, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules for a language, or of a category."""
    return [r for r in rules if (language is None or not r.languages or language in r.languages) and (category is None or r.category == category)]


def _hits(lines: Column, rules: Sequence[Rule]) -> Column:
    """array of structs: what the rules match in a file and context doesn't suppress."""
    content = F.col("content")

    def of(rule: Rule) -> Column:
        found = F.struct(F.lit(rule.ord).alias("rule_ord"), F.regexp_extract_all(content, F.lit(java(rule.pattern)), F.lit(0)).alias("found"), F.split(content, java(rule.pattern), -1).alias("gaps"))
        return F.when(applies(rule, F.col("language")) & content.rlike(java(rule.pattern)), found)

    def kept(h: Column) -> Column:
        out = F.lit(True)
        for rule in rules:
            if rule.negatives:
                hushed = h["around"].rlike(java("|".join(f"(?:{n})" for n in rule.negatives), many_lines=False))
                out = F.when(h["rule_ord"] == rule.ord, ~hushed).otherwise(out)
        return out & ~h["comment"]

    def placed(rows: Column) -> Column:
        def one(ord_: Column, m: Column) -> Column:
            row = m["line_start"]
            begin = F.greatest(row - CONTEXT, F.lit(1))
            return F.struct(
                ord_.alias("rule_ord"), m["k"].alias("match_ord"), row.alias("line_start"), m["line_end"].alias("line_end"), m["col_start"].alias("col_start"), F.left(m["text"], F.lit(200)).alias("matched"),
                F.array_join(F.slice(rows, begin, row + CONTEXT - begin + 1), "\n").alias("around"), F.btrim(F.get(rows, row - 1)).rlike(COMMENT).alias("comment"), snippet(lines, row, m["line_end"]).alias("snippet"),
            )

        each = F.array_compact(F.array(*map(of, rules)))
        return F.flatten(F.transform(each, lambda r: F.transform(positions(r["found"], r["gaps"]), lambda m: one(r["rule_ord"], m))))

    return F.filter(let(F.split(content, "\n", -1), placed), kept)


def rule_matches(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(path, rule_ord, match_ord, line_start, line_end, col_start, matched, snippet) of matches that context doesn't suppress."""
    hits = let(split_lines(F.col("content")), lambda lines: _hits(lines, rules))
    return files.select("path", F.explode(hits).alias("h")).select("path", "h.*").drop("around", "comment")


def rule_rows(lines: Column, rules: Sequence[Rule] = RULES) -> Column:
    """A file's findings of the rules."""
    known = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in (("id", r.id), ("title", r.title), ("category", r.category), ("severity", r.severity), ("cwe", r.cwe), ("owasp", r.owasp), ("confidence", r.confidence)))) for r in rules))
    place = F.create_map(*(F.lit(v) for i, r in enumerate(rules) for v in (r.ord, i)))

    def one(h: Column) -> Column:
        return let(
            F.get(known, F.element_at(place, h["rule_ord"])),
            lambda r: finding(
                stage_ord=3, rule_id=r["id"], title=r["title"], category=r["category"], severity=r["severity"], line_start=h["line_start"], line_end=h["line_end"], col_start=h["col_start"], snippet=h["snippet"], cwe_id=r["cwe"],
                owasp=r["owasp"], confidence=r["confidence"], method="sast_rule", source=h["matched"], ord_a=h["rule_ord"], ord_b=h["match_ord"],
            ),
        )

    return F.transform(_hits(lines, rules), one)


def rule_findings(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of the rules, with their snippets."""
    return explode_findings(files, lambda lines: rule_rows(lines, rules))
