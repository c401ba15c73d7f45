"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulestream.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.sharding import assign_shards

    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


@query
def op6_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.warc import round_trip

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return round_trip(pages).withColumnRenamed("id", "page_id")


ORACLES["op6_content_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS newest FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN m.newest <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.newest <> p.page_id THEN m.newest END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.linededup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = dedup_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op7_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.bpe import encode, public_vocabulary

    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_vocabulary(), decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.qualityrules import apply_rules

    ruled = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLES["op1_line_frequency_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
), ln AS (
  SELECT doc_id, source, array_to_string(regexp_extract_all(lower(l), '[^\x20\x09-\x0D]+'), ' ') AS key,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, l
  FROM (SELECT doc_id, source, unnest(lines) AS l FROM d)
), common AS (
  SELECT source, key FROM ln WHERE key <> '' GROUP BY source, key HAVING count(DISTINCT doc_id) >= 20
), gone AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS removed_words FROM ln JOIN common USING (source, key) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln WHERE key <> '' GROUP BY doc_id
), s AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN dup USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept FROM b
"""


@query
def op3_class_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.common import held_out
    from rulestream.llm.toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


@query
def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.common import held_out
    from rulestream.llm.rulefit import score_documents, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, ensemble, least=0.7).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


@query
def op10_family_then_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.common import held_out
    from rulestream.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


@query
def op4_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.neardup import cluster

    return cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op4_minhash_bayes"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
"""


@query
def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rulestream.llm.decontaminate import find_contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
