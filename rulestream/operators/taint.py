"""Flows from sources to sinks within a file, by words and distance: in the file's row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.catalogs import taint as words
from rulestream.functions.text import let, snippet, split_lines
from rulestream.operators.rows import explode_findings, finding

LANGUAGES = tuple(words.SOURCES)


def _any(patterns: list[str]) -> str:
    """A pattern for any of some literal words."""
    return "|".join("".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in p) for p in patterns)


def assigned(line: Column, language: str) -> Column:
    """The variable that a line assigns, or null."""
    return F.nullif(F.regexp_extract(line, words.ASSIGNED[language], 1), F.lit(""))


def _per_language(build) -> Column:
    """What ``build(language)`` gives for the row's language; null for the others."""
    out = None
    for language in LANGUAGES:
        test = F.col("language") == language
        out = F.when(test, build(language)) if out is None else out.when(test, build(language))
    return out


def _hits(rows: Column, patterns: list[tuple], fields: str) -> Column:
    """For each given line, the catalogue entries whose pattern (last field) it contains."""
    names = fields.split()
    entries = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(p, names))) for p in patterns))
    return F.flatten(F.transform(rows, lambda r: F.transform(F.filter(entries, lambda e: F.contains(r["text"], e["pat"])), lambda e: F.struct(r["line"].alias("line"), r["text"].alias("text"), e.alias("e")))))


def _numbered(lines: Column) -> Column:
    return F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))


def _sources(rows: Column) -> Column:
    """The source hits of a file's numbered lines, which one pattern for all words of the language thins out first."""

    def of(language: str) -> Column:
        hits = _hits(F.filter(rows, lambda r: r["text"].rlike(_any(words.SOURCES[language]))), list(enumerate(words.SOURCES[language])), "ord pat")
        return F.transform(hits, lambda h: F.struct(h["line"].alias("line"), h["text"].alias("text"), h["e"]["ord"].alias("ord"), h["e"]["pat"].alias("pat"), assigned(h["text"], language).alias("var")))

    return _per_language(of)


def _sinks(rows: Column) -> Column:
    """The sink hits of a file's numbered lines that no sanitizer stops."""

    def of(language: str) -> Column:
        some = F.filter(rows, lambda r: r["text"].rlike(_any([p for *_, p in words.sink_rows(language)])) & ~r["text"].rlike(_any(words.SANITIZERS[language])))
        hits = _hits(some, words.sink_rows(language), "flaw_ord flaw ord pat")
        return F.transform(hits, lambda h: F.struct(h["line"].alias("line"), h["text"].alias("text"), h["e"]["flaw_ord"].alias("flaw_ord"), h["e"]["flaw"].alias("flaw"), h["e"]["ord"].alias("ord"), h["e"]["pat"].alias("pat")))

    return _per_language(of)


def source_hits(files: DataFrame) -> DataFrame:
    """(path, line_no, pattern, variable): a row for each source word of each line."""
    hits = files.select("path", F.explode(let(split_lines(F.col("content")), lambda lines: _sources(_numbered(lines)))).alias("s"))
    return hits.select("path", F.col("s.line").alias("line_no"), F.col("s.pat").alias("pattern"), F.col("s.var").alias("variable"))


def _flows(lines: Column) -> Column:
    """A file's flows: a struct for each pair of a source and a sink, without what the lines hold beside these."""

    def order(s: Column, k: Column, direct: bool) -> Column:
        # traced: by source line, source word, sink line, flaw, sink word; direct: by line, flaw, sink word, source word
        if direct:
            return F.format_string("1%08d%04d%04d%04d", s["line"], k["flaw_ord"], k["ord"], s["ord"])
        return F.format_string("0%08d%04d%08d%04d%04d", s["line"], s["ord"], k["line"], k["flaw_ord"], k["ord"])

    def pair(s: Column, direct: bool):
        return lambda k: F.struct(F.lit("direct" if direct else "traced").alias("kind"), s.alias("s"), k.alias("k"), F.lit(words.DIRECT if direct else words.TRACED).alias("confidence"), order(s, k, direct).alias("flow_ord"))

    def of(s: Column, sinks: Column) -> Column:
        ahead = F.filter(sinks, lambda k: s["var"].isNotNull() & (k["line"] > s["line"]) & (k["line"] <= s["line"] + words.LOOK_AHEAD) & F.contains(k["text"], s["var"]))
        here = F.filter(sinks, lambda k: k["line"] == s["line"])
        return F.concat(F.transform(ahead, pair(s, False)), F.transform(here, pair(s, True)))

    def met(rows: Column) -> Column:
        return let(_sinks(rows), lambda sinks: F.when(F.size(sinks) > 0, F.flatten(F.transform(_sources(rows), lambda s: of(s, sinks)))))

    return F.when(F.col("language").isin(*LANGUAGES), let(_numbered(lines), met))


def flows(files: DataFrame) -> DataFrame:
    """(path, kind, source and sink lines, flaw, confidence, order): flows that no sanitizer stops.

    Traced flows go from a line that assigns a variable to sinks on the next lines that name it;
    direct ones have source and sink on one line. Traced ones come first.
    """
    rows = files.select("path", F.explode(let(split_lines(F.col("content")), _flows)).alias("f"))
    s, k = F.col("f.s"), F.col("f.k")
    return rows.select(
        "path", "f.kind", s["line"].alias("source_line"), F.btrim(s["text"]).alias("source"), s["pat"].alias("source_word"), s["var"].alias("variable"),
        k["line"].alias("sink_line"), F.btrim(k["text"]).alias("sink"), k["pat"].alias("sink_word"), k["flaw"].alias("flaw"), "f.confidence", "f.flow_ord",
    )


def taint_rows(lines: Column) -> Column:
    """A file's flows as findings, from the source's line to the sink's."""
    known = [F.create_map(*(F.lit(v) for flaw, said in words.FLAWS.items() for v in (flaw, said[i]))) for i in range(4)]

    def one(f: Column) -> Column:
        s, k = f["s"], f["k"]
        category, cwe, owasp, severity = (F.element_at(m, k["flaw"]) for m in known)
        return finding(
            stage_ord=4, rule_id=F.concat(F.lit("TAINT_"), F.upper(k["flaw"])), title=F.concat(F.lit("Caller's data reaches a sink: "), F.replace(k["flaw"], F.lit("_"), F.lit(" "))), category=category, severity=severity,
            line_start=s["line"], line_end=k["line"], snippet=snippet(lines, s["line"], k["line"]), cwe_id=cwe, owasp=owasp, confidence=f["confidence"], method="taint_analysis",
            source=F.left(F.btrim(s["text"]), F.lit(300)), sink=F.left(F.btrim(k["text"]), F.lit(300)), ord_a=0, ord_b=0, flow_ord=f["flow_ord"],
        )

    return F.transform(_flows(lines), one)


def taint_findings(files: DataFrame) -> DataFrame:
    """The flows as findings."""
    return explode_findings(files, taint_rows)
