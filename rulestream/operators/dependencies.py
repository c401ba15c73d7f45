"""Packages of manifests, and what is wrong with them: advisories, look-alike names, internal names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulestream.catalogs import dims
from rulestream.functions.text import base_name, let, split_lines
from rulestream.operators.rows import explode_findings, finding

MOST_PACKAGES, MOST_ADVISORIES, DISTANCE = 50, 3, 2


def manifests(files: DataFrame) -> DataFrame:
    """(path, filename, ecosystem, content) of files with a manifest's exact name."""
    ecosystem = F.create_map(*(F.lit(v) for kv in dims.MANIFESTS.items() for v in kv))
    named = files.withColumn("filename", base_name(F.col("path")))
    return named.where(F.col("filename").isin(*dims.MANIFESTS)).select("path", "filename", F.element_at(ecosystem, F.col("filename")).alias("ecosystem"), "content")


def _package(name: Column, version: Column, line: Column, ok: Column) -> Column:
    return F.when(ok, F.struct(name.alias("name"), version.alias("version"), line.cast("int").alias("line")))


def _by_line(read) -> Column:
    """The packages that ``read`` finds in lines: it gives name, version and whether the line has one."""

    def one(text: Column, at: Column) -> Column:
        name, version, ok = read(text)
        return _package(name, version, at + 1, ok)

    return F.array_compact(F.transform(split_lines(F.col("content")), one))


def _quoted(text: Column) -> Column:
    """What lies outside of quotes (even places) and inside (odd ones), without regard to the kind of quote."""
    return F.split(F.translate(text, "'", '"'), '"', -1)


def _requirement(text: Column) -> tuple[Column, Column, Column]:
    """A name, some of the signs of comparison, a version; extras in brackets are left out."""
    sides = F.split(F.regexp_replace(F.btrim(text), r"\[[^\]]*\]", ""), "[<>=!~^]+", 2)
    name, version = F.rtrim(F.get(sides, 0)), F.regexp_extract(F.ltrim(F.get(sides, 1)), r"^[\w.]+", 0)
    return F.lower(name), version, name.rlike(r"^[\w.-]+$") & (version != "")


def _go_module(text: Column) -> tuple[Column, Column, Column]:
    """An indented line of a module and its version, which begins with v."""
    words = F.split(F.btrim(text, F.lit(" \t")), "[ \t]+")
    version = F.regexp_extract(F.get(words, 1), r"^v([\w.]+)", 1)
    return F.get(words, 0), version, text.rlike(r"^[ \t]") & F.get(words, 0).rlike(r"^[\w./-]+$") & (version != "")


def _gem(text: Column) -> tuple[Column, Column, Column]:
    """A line of a gem from its first column on: its name in quotes, then perhaps a version in quotes."""
    parts = _quoted(text)
    named = F.get(parts, 0).rlike(r"^gem[ \t]+$") & F.get(parts, 1).rlike(r"^\w[\w-]+$") & (F.size(parts) > 2)
    version = F.when(F.get(parts, 2).rlike(r"^[ \t]*,[ \t]*$") & (F.size(parts) > 4), F.nullif(F.get(parts, 3), F.lit("")))
    return F.get(parts, 1), F.coalesce(version, F.lit("unknown")), named


def _crate(text: Column) -> tuple[Column, Column, Column]:
    """A key, an equals sign, a version in quotes; the keys that describe the package itself are none."""
    parts = _quoted(text)
    key = F.rtrim(F.substring_index(F.get(parts, 0), "=", 1), F.lit(" \t"))
    ok = F.get(parts, 0).rlike(r"^\w\w+[ \t]*=[ \t]*$") & (F.size(parts) > 2) & (F.get(parts, 1) != "")
    return key, F.get(parts, 1), ok & ~key.isin("name", "version", "edition")


def _by_section(sections: tuple[str, ...], digits: bool) -> Column:
    read = F.from_json("content", F.lit(", ".join(f"`{s}` map<string,string>" for s in sections)))
    parts = [F.coalesce(F.map_entries(read[s]), F.array().cast("array<struct<key:string,value:string>>")) for s in sections]

    def one(entry: Column) -> Column:
        version = entry["value"]
        bare = F.regexp_replace(version, "[^0-9.]", "")
        return _package(entry["key"], F.when(bare == "", version).otherwise(bare) if digits else version, F.lit(0), F.lit(True))

    return F.transform(F.concat(*parts), one)


def _packages(file: Column) -> Column:
    """array<struct<name, version, line>> of a manifest's content, by its file's name; null for one without a parser."""
    return (
        F.when(file.startswith("requirements"), _by_line(_requirement))
        .when(file == "package.json", _by_section(("dependencies", "devDependencies", "peerDependencies"), digits=True))
        .when(file == "go.mod", _by_line(_go_module))
        .when(file == "Gemfile", _by_line(_gem))
        .when(file == "composer.json", _by_section(("require", "require-dev"), digits=False))
        .when(file == "Cargo.toml", _by_line(_crate))
    )


def packages(of: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version, line, pkg_ord): packages with their place in the manifest.

    A manifest without a parser gives none. JSON manifests have line 0 for all.
    """
    found = of.select("path", "ecosystem", F.posexplode(_packages(F.col("filename"))).alias("pkg_ord", "p"))
    return found.select("path", "ecosystem", "p.name", "p.version", "p.line", "pkg_ord")


def advisory_severity(score: Column, label: Column) -> Column:
    """By bands of the score; without one by the label, MEDIUM if that isn't known."""
    s = F.coalesce(score, F.lit(0.0))
    said = F.upper(F.coalesce(label, F.lit("")))
    return F.when(s >= 9, "CRITICAL").when(s >= 7, "HIGH").when(s >= 4, "MEDIUM").when(s > 0, "LOW").when(said.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), said).otherwise("MEDIUM")


def advisory_matches(pkgs: DataFrame, advisories: DataFrame) -> DataFrame:
    """Advisories of the first packages of each manifest, the first few of each package.

    ``advisories`` has ecosystem, name, version, advisory_id, label, fixed, score and vuln_ord.
    Packages without a version are looked up by nobody, and don't shift the others.
    """
    asked = pkgs.where((F.col("pkg_ord") < MOST_PACKAGES) & F.col("version").isNotNull() & (F.col("version") != "unknown") & (F.col("version") != ""))
    found = asked.join(advisories, ["ecosystem", "name", "version"])
    nth = F.row_number().over(Window.partitionBy("path", "pkg_ord").orderBy("vuln_ord", "advisory_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= MOST_ADVISORIES).withColumn("severity", advisory_severity(F.col("score"), F.col("label")))


def _popular(ecosystem: Column) -> Column:
    """The popular names that an ecosystem's packages are compared with: PyPI's list for PyPI, npm's for all others."""
    return F.when(ecosystem == "PyPI", F.array(*map(F.lit, dims.POPULAR["PyPI"]))).otherwise(F.array(*map(F.lit, dims.POPULAR["npm"])))


def look_alikes(pkgs: DataFrame) -> DataFrame:
    """Packages one or two edits from a popular name."""
    near = pkgs.select("*", F.posexplode(_popular(F.col("ecosystem"))).alias("popular_ord", "popular")).withColumn("distance", F.levenshtein("name", "popular", DISTANCE))
    return near.where(F.col("distance").between(1, DISTANCE))


def _internal(name: Column) -> Column:
    first = [F.startswith(name, F.lit(w + sign)) for w in dims.INTERNAL_FIRST for sign in "-_"]
    return reduce(or_, first + [F.endswith(name, F.lit(sign + w)) for w in dims.INTERNAL_LAST for sign in "-_"])


def internal_names(pkgs: DataFrame) -> DataFrame:
    return pkgs.where(_internal(F.lower("name")))


def _row(kind: str, step: int, severity, title: Column, line: Column, place: Column, second) -> Column:
    return finding(
        stage_ord=2, rule_id=f"DEP_{kind}", title=title, category="dependency", severity=severity, line_start=line, line_end=line, snippet="", cwe_id="CWE-1035", confidence=0.95, method="dependency_scanning",
        ord_a=F.lit(step * 1_000_000) + place, ord_b=second,
    )


def dependency_rows(lines: Column | None = None) -> Column:
    """A file's findings by the names of its packages, if it is a manifest."""
    file = base_name(F.col("path"))
    popular = _popular(F.element_at(F.create_map(*(F.lit(v) for kv in dims.MANIFESTS.items() for v in kv)), file))

    def alike(p: Column, i: Column) -> Column:
        near = F.filter(F.transform(popular, lambda n, j: F.struct(n.alias("n"), j.alias("j"))), lambda q: F.levenshtein(p["name"], q["n"], DISTANCE).between(1, DISTANCE))
        return F.transform(near, lambda q: _row("TYPOSQUATTING", 1, "HIGH", F.concat(F.lit("Package name close to a popular one: "), p["name"], F.lit(" ~ "), q["n"]), p["line"], i, q["j"]))

    def found(pkgs: Column) -> Column:
        placed = F.filter(F.transform(pkgs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: _internal(F.lower(x["p"]["name"])))
        internal = F.transform(placed, lambda x: _row("CONFUSION", 2, "MEDIUM", F.concat(F.lit("Package name looks internal: "), x["p"]["name"]), x["p"]["line"], x["i"], 0))
        return F.concat(F.flatten(F.transform(pkgs, alike)), internal)

    return F.when(file.isin(*dims.MANIFESTS), let(_packages(file), found))


def advisory_findings(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings by advisories: a pass of its own, over manifests alone."""
    found = advisory_matches(packages(manifests(files)), advisories)
    row = _row("CVE", 0, F.col("severity"), F.concat("advisory_id", F.lit(" in "), "name", F.lit(" "), "version"), F.col("line"), F.col("pkg_ord"), F.col("nth"))
    return found.select(F.col("path").alias("file_path"), row.alias("f")).select("file_path", "f.*")


def dependency_findings(files: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Findings of all three kinds."""
    out = explode_findings(files, dependency_rows)
    return out if advisories is None else out.unionByName(advisory_findings(files, advisories))
