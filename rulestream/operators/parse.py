"""Languages, lines, structure and frameworks of source files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.catalogs import dims
from rulestream.functions.text import base_name, line_count, positions, split_lines

_DOUBLE, _SINGLE, _BACKTICK = r"\"[^\"\\\n]*\"", r"'[^'\\\n]*'", "`[^`]*`"
# What a line must hold to count as a function, a class or an import (a name in a group), and what a string is, by language.
# Others use javascript's.
PACKS = {
    "python": (r"^[ \t]*(?:async +)?def +(\w+)", r"^[ \t]*class +(\w+)", r"^[ \t]*(?:from|import) +\S", f"{_DOUBLE}|{_SINGLE}"),
    "javascript": (r"\bfunction\b[ \t]+(\w+)|\b(?:const|let|var)\b[ \t]+(\w+)[ \t]*=[ \t]*(?:async\b[ \t]*)?(?:\(|function\b)", r"\bclass\b[ \t]+(\w+)", r"\b(?:import[ \t]|require\()", f"{_BACKTICK}|{_DOUBLE}|{_SINGLE}"),
    "java": (r"\b(?:private|protected|public|static)[ \t]+[^\s()=;]+[ \t]+(\w+)[ \t]*\(", r"\bclass\b[ \t]+(\w+)", r"^[ \t]*import\b[^;\n]+;", _DOUBLE),
    "php": (r"\bfunction\b[ \t]+&?(\w+)", r"\bclass\b[ \t]+(\w+)", r"\b(?:use|include|require)[ \t]", f"{_DOUBLE}|{_SINGLE}"),
    "go": (r"\bfunc\b[ \t]*(?:\([^()\n]*\))?[ \t]*(\w+)[ \t]*\(", r"\btype\b[ \t]+(\w+)[ \t]+struct\b", r"\"[\w./-]+\"", f"{_BACKTICK}|{_DOUBLE}"),
}
KINDS = ("function", "class", "import")


def detect_language(path: Column) -> Column:
    """The language of a path: by its lower-cased suffix, else by its exact name, else null."""
    name = base_name(path)
    suffix = F.lower(F.regexp_extract(name, r"(?s).(\.[^.]*)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in dims.SUFFIXES.items() for v in kv)), suffix), F.try_element_at(F.create_map(*(F.lit(v) for kv in dims.NAMES.items() for v in kv)), name))


def language_histogram(files: DataFrame) -> DataFrame:
    """(language, n_files) of files with a known language."""
    return files.where(F.col("language").isNotNull()).groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, language, line_no, text), without a shuffle."""
    return files.select("path", "language", F.posexplode(split_lines(F.col("content"))).alias("_at", "text")).select("path", "language", (F.col("_at") + 1).alias("line_no"), "text")


def lines_scanned(files: DataFrame) -> DataFrame:
    """(n_files, n_lines): lines are newlines and one for each file."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(line_count(F.col("content"))), F.lit(0)).cast("bigint").alias("n_lines"))


def pack_of(language: Column) -> Column:
    return F.when(language.isin(*PACKS), language).otherwise("javascript")


def nodes(files: DataFrame) -> DataFrame:
    """(path, kind, name, text, line_no): the first function, class and import of each line, and all strings."""
    by_line = lines_of(files).withColumn("pack", pack_of(F.coalesce("language", F.lit(""))))

    def found(kind: int) -> Column:
        hit, name = F.lit(False), F.lit("")
        for pack, patterns in PACKS.items():
            at = F.col("text").rlike(patterns[kind])
            groups = 0 if kind == 2 else 2 if pack == "javascript" and kind == 0 else 1
            taken = reduce(lambda a, b: F.when(a != "", a).otherwise(b), [F.regexp_extract("text", patterns[kind], g) for g in range(1, groups + 1)]) if groups else F.lit("")
            hit = F.when(F.col("pack") == pack, at).otherwise(hit)
            name = F.when(F.col("pack") == pack, taken).otherwise(name)
        return F.when(hit, F.struct(F.lit(KINDS[kind]).alias("kind"), name.alias("name"), F.left(F.btrim("text"), F.lit(200)).alias("text")))

    structure = by_line.select("path", "line_no", F.explode(F.array_compact(F.array(*(found(k) for k in range(3))))).alias("n")).select("path", "n.kind", "n.name", "n.text", "line_no")
    strings = F.array().cast("array<string>")
    gaps = strings
    for pack, patterns in PACKS.items():
        of = pack_of(F.coalesce("language", F.lit(""))) == pack
        strings = F.when(of, F.regexp_extract_all("content", F.lit(patterns[3]), F.lit(0))).otherwise(strings)
        gaps = F.when(of, F.split("content", patterns[3], -1)).otherwise(gaps)
    read = files.select("path", positions(strings, gaps).alias("_found"))
    literals = read.select("path", F.explode("_found").alias("m")).select("path", F.lit("string").alias("kind"), F.lit("").alias("name"), F.left("m.text", F.lit(200)).alias("text"), F.col("m.line_start").alias("line_no"))
    return structure.unionByName(literals)


def frameworks(files: DataFrame) -> DataFrame:
    """(framework): what the imports of all files together, and some file names, point to.

    Each import line is tested by itself, so no text is gathered: a signal never spans lines.
    """
    imports = nodes(files).where("kind = 'import'").select(F.lower("text").alias("t"))
    signal = F.array_compact(F.array(*(F.when(reduce(or_, (F.contains(F.col("t"), F.lit(s)) for s in signals)), F.lit(name)) for name, signals in dims.FRAMEWORKS.items())))
    name = F.lower(base_name(F.col("path")))
    hint = F.when(name.isin(*dims.DJANGO_FILES), "Django").when((name == "app.py") & F.contains(F.lower("content"), F.lit("flask")), "Flask").when(name == "next.config.js", "NextJS")
    return imports.select(F.explode(signal).alias("framework")).union(files.select(hint.alias("framework")).where("framework IS NOT NULL")).distinct()
