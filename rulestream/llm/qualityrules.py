"""Quality rules: base rules of one text, and line frequency across the documents of a host.

Base: ``word_chars``, ``n_words``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` of the whole
text; ``base_failed`` where there are too few words or too large a part of them lies in repeated
windows. Across documents: lines are normalised (white space stripped and folded, lower-cased) and
hashed, the distinct documents that hold a line are counted per host, lines held by at least
``max_docs`` of a host are removed from that host's documents, and a document left with less than
``min_left`` of its words is depleted and rejected.

DataFrame functions only. Nothing but hashes, ids and word counts is shuffled, the counts are
pre-aggregated per task, and the join that removes lines may be split where one line is hot.

Defined results: a null or empty text has no words and fails the base rules. Rows that share a
doc_id count as one document of their host, rows with a null doc_id as one, and a null host is a
host of its own. Repeated rows each have their own, equal result. An empty table gives an empty
table. Bytes that aren't UTF-8 are kept as they are in comparisons. Other input columns pass through
``apply_rules``; its own columns replace those of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.llm.common import WS_CHARS, col, free, text_hash, without

WS_RE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MADE = ("word_chars", "n_symbols", "n_dup_lines", "n_words", "n_repeat_words", "removed_words", "base_failed", "kept")


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_docs: int = 20  #: a line in so many documents of one host is removed
    min_left: float = 0.5  #: of a document's words


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE, -1))


def with_stats(docs: DataFrame, window: int = 8) -> DataFrame:
    """``docs`` with the base statistics of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, rows, h, s, at = free(docs, "_w", "_lines", "_h", "_s", "_at")
    with_word = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    step = docs.withColumns({w: _words(text), rows: with_word})
    step = step.withColumns(
        {
            "word_chars": F.length(F.translate(text, WS_CHARS, "")).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size(rows) - F.size(F.array_distinct(rows))).cast("bigint"),
            "n_words": F.size(w).cast("bigint"),
            w: F.transform(w, lambda x: F.xxhash64(x)),
        }
    ).drop(rows)
    starts = F.when(F.col("n_words") > window, F.sequence(F.lit(1), (F.col("n_words") - window + 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    step = step.withColumn(h, F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(w), i, window)))).drop(w)
    # most texts repeat no window; only the others sort theirs
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    step = step.withColumn(s, F.when(repeats, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop(h)
    twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    step = step.withColumn(at, F.sort_array(F.transform(twice, lambda x: x["i"]))).drop(s)
    # a repeated window covers its words up to where the next one begins
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop(at)


def _lines(docs: DataFrame) -> DataFrame:
    """(host, key, doc_id, th, w) of (host, doc_id, th, text): each line with words, hashed; w words."""
    # white space within lines is folded once for the whole text, so words needn't be cut out to be counted
    folded = F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    step = docs.select("host", "doc_id", "th", F.explode(F.split(folded, "\n", -1)).alias("line"))
    step = step.withColumn("line", F.btrim("line", F.lit(" "))).where(F.col("line") != "")
    words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return step.select("host", "doc_id", "th", F.unhex(F.md5("line")).alias("key"), words.alias("w"))


def _slim(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(col(host).alias("host"), "doc_id", text_hash().alias("th"), "text")


def _frequent(lines: DataFrame, max_docs: int) -> DataFrame:
    held = lines.select("host", "key", "doc_id").distinct()
    return held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= max_docs)


def line_frequency(docs: DataFrame, host: str = "source", max_docs: int = 20) -> DataFrame:
    """(host, key, n_docs) of the lines that at least ``max_docs`` documents of a host hold."""
    return _frequent(_lines(_slim(docs, host)), max_docs)


def apply_rules(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``removed_words`` and ``kept``."""
    slim = _slim(docs, host)
    lines = _lines(slim)
    common = _frequent(lines, limits.max_docs).select(F.col("host").alias("h"), F.col("key").alias("k"))
    # repeated rows meet here: a set of (key, count of that line, words), so none is counted twice
    hit = lines.join(common, lines["host"].eqNullSafe(common["h"]) & (lines["key"] == common["k"]), "left_semi")
    per_line = hit.groupBy("doc_id", "th", "host", "key").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n"))
    removed = per_line.groupBy("doc_id", "th", "host").agg(F.sum(F.col("w") * F.col("n")).alias("removed"))
    copies = slim.groupBy("doc_id", "th", "host").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    d, t, h, hh, th, gone, n = free(docs, "_d", "_t", "_h", "_hh", "_th", "_removed", "_copies")
    keyed = without(docs, *(c for c in MADE if c.lower() != host.lower())).withColumns({th: text_hash(), h: col(host)})
    joined = with_stats(keyed, limits.window)
    for found, value, name in ((removed, "removed", gone), (copies, "copies", n)):
        found = found.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("host").alias(hh), F.col(value).alias(name))
        joined = joined.join(found, joined["doc_id"].eqNullSafe(found[d]) & joined[th].eqNullSafe(found[t]) & joined[h].eqNullSafe(found[hh]), "left").drop(d, t, hh)
    each = (F.coalesce(F.col(gone), F.lit(0)) / F.coalesce(F.col(n), F.lit(1))).cast("bigint")
    left = F.col("n_words") - F.col("removed_words")
    depleted = left < limits.min_left * F.col("n_words")
    return (
        joined.withColumn("removed_words", each)
        .withColumn("base_failed", (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .drop(th, h, gone, n)
    )
