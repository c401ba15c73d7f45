"""Context checks: anchors on lines and guard words around them, in the file's row, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.catalogs.checks import CHECKS, Check, Guard
from rulestream.functions.text import java, let, snippet, split_lines
from rulestream.operators.parse import pack_of
from rulestream.operators.rows import explode_findings, finding

REACH = 20


def _rows(lines: Column) -> Column:
    """Lines with their numbers and their lower-cased texts, which are made once for all words of all checks."""
    return F.transform(lines, lambda t, i: F.struct((i + 1).alias("n"), t.alias("t"), F.lower(t).alias("l")))


def _has(row: Column, guard: Guard) -> Column:
    if guard.regex:
        return row["t"].rlike(java("|".join(f"(?:{w})" for w in guard.words), many_lines=False))
    said = row["l"] if guard.lower else row["t"]
    return reduce(or_, (F.contains(said, F.lit(w)) for w in guard.words))


def _window(rows: Column, first: Column, last: Column) -> Column:
    begin, stop = F.greatest(first, F.lit(1)), F.least(last, F.size(rows))
    return F.slice(rows, begin, F.greatest(stop - begin + 1, F.lit(0)))


def _holds(check: Check, rows: Column, at: Column, last: Column | None = None) -> Column:
    """Whether all guards of a check hold around line ``at``; ``last`` replaces their windows by [at, last]."""
    tests = [F.lit(True)]
    for guard in check.guards:
        near = _window(rows, at, last) if last is not None else _window(rows, at + guard.window[0], at + guard.window[1])
        found = F.exists(near, _test(_has, guard))
        tests.append(found if guard.present else ~found)
    return reduce(and_, tests)


def _anchor(check: Check, row: Column, pattern: str | None) -> Column:
    text = row["t"]
    tests = [reduce(or_, (F.contains(row["l"], F.lit(w)) for w in ws)) for ws in check.needs]
    if pattern is not None:
        tests.insert(0, text.rlike(java(pattern, many_lines=False)))
    if check.by_language:
        own = None
        for language, p in check.by_language.items():
            hit = text.rlike(java(p, many_lines=False))
            test = pack_of(F.coalesce("language", F.lit(""))) == language
            own = F.when(test, hit) if own is None else own.when(test, hit)
        tests.append(F.coalesce(own, F.lit(False)))
    return reduce(and_, tests)


def _test(has, guard: Guard):
    return lambda r: has(r, guard)


def _at_anchor(check: Check, anchor: str | None):
    return lambda r: _anchor(check, r, anchor)


def _hit(number: int, line: Column, end: Column, pat: int) -> Column:
    return F.struct(F.lit(number).alias("check_ord"), line.alias("line"), end.alias("end"), F.lit(pat).alias("pat"))


def _as_hit(number: int, pat: int, end):
    return lambda r: _hit(number, r["n"], end(r), pat)


def _with_act(rows: Column, act: str):
    """A row with ``m``, the first line within reach that the act matches."""

    def run(r: Column) -> Column:
        after = _window(rows, r["n"] + 1, r["n"] + REACH)
        return F.struct(r["n"].alias("n"), F.get(F.filter(after, lambda x: x["t"].rlike(java(act, many_lines=False))), 0)["n"].alias("m"))

    return run


def _hits(number: int, check: Check, rows: Column) -> Column:
    """array<struct<check_ord, line, end, pat>> of a check over a file's numbered lines; null where its path is left out."""
    path = F.lower("path")
    if check.whole_file:
        found = F.when(_holds_nowhere(check, rows), F.array(_hit(number, F.lit(1), F.lit(1), 0)))
    else:
        parts = []
        for pat, anchor in enumerate(check.anchors or (None,)):
            here = F.filter(rows, _at_anchor(check, anchor))
            if check.acts:
                here = F.filter(F.transform(here, _with_act(rows, check.acts[pat])), lambda r: r["m"].isNotNull() & _holds(check, rows, r["n"], r["m"]))
                found = F.transform(here, _as_hit(number, pat, lambda r: r["m"]))
            else:
                here = F.filter(here, lambda r: _holds(check, rows, r["n"]))
                found = F.transform(here, _as_hit(number, pat, lambda r: F.least(r["n"] + check.end, F.size(rows))))
            parts.append(found)
        found = F.concat(*parts) if len(parts) > 1 else parts[0]
        found = F.slice(found, 1, 1) if check.first else found
    limits = [~F.contains(path, F.lit(w)) for w in check.path_lacks]
    if check.path_has:
        limits.append(reduce(or_, (F.contains(path, F.lit(w)) for w in check.path_has)))
    return F.when(reduce(and_, limits), found) if limits else found


def _holds_nowhere(check: Check, rows: Column) -> Column:
    return reduce(and_, (~F.exists(rows, _test(_has, g)) for g in check.guards))


def context_hits(files: DataFrame, checks: Sequence[Check] = CHECKS) -> DataFrame:
    """(path, check_ord, line, end, pat) of all checks."""
    hits = let(_rows(split_lines(F.col("content"))), lambda rows: F.flatten(F.array_compact(F.array(*(_hits(i, c, rows) for i, c in enumerate(checks))))))
    return files.select("path", F.explode(hits).alias("h")).select("path", "h.*")


def _row(check: Check, lines: Column):
    """A hit as a finding; the snippet's span is the check's own."""

    def run(h: Column) -> Column:
        first = F.greatest(h["line"] + check.span[0], F.lit(1))
        last = h["end"] if check.acts else F.least(h["line"] + check.span[1], F.size(lines))
        return finding(
            stage_ord=5, rule_id=check.id, title=check.title, category=check.category, severity=check.severity, line_start=h["line"], line_end=h["end"], snippet="" if check.whole_file else snippet(lines, first, last),
            cwe_id=check.cwe, owasp=check.owasp, confidence=check.confidence, method="business_logic", ord_a=h["check_ord"], ord_b=h["line"] * 16 + h["pat"],
        )

    return run


def context_rows(lines: Column, checks: Sequence[Check] = CHECKS) -> Column:
    """A file's findings of the checks."""
    return let(_rows(lines), lambda rows: F.flatten(F.array_compact(F.array(*(F.transform(_hits(i, c, rows), _row(c, lines)) for i, c in enumerate(checks))))))


def context_findings(files: DataFrame, checks: Sequence[Check] = CHECKS) -> DataFrame:
    """The checks' findings."""
    return explode_findings(files, lambda lines: context_rows(lines, checks))
