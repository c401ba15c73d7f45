"""Every operator with columns named like its own, bytes that aren't UTF-8, and no rows."""

import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import rulestream.llm
from rulestream.llm import bpe, decontaminate, langid, linededup, neardup, qualityrules, rulefit, sharding, toxicity, warc

#: Every name that the operators' code gives to a column, whatever table that is in.
SOURCES = "\n".join(p.read_text() for p in Path(rulestream.llm.__file__).parent.glob("*.py"))
PRIVATE = sorted({n for n in re.findall(r"""["'](_?[A-Za-z][A-Za-z_]*)["']""", SOURCES) if len(n) < 20} - {"doc_id", "text", "source", "lang", "item_id"})
RESULTS = {
    "op1": {"word_chars", "n_symbols", "n_dup_lines", "n_words", "n_repeat_words", "removed_words", "base_failed", "kept"}, "op2": {"slot", "shard"}, "op3": {"score", "predicted"}, "op4": set(), "op5": set(), "op6": set(),
    "op7": {"n_lines", "n_dropped"}, "op8": {"score", "predicted"}, "op9": {"ids", "n_tokens", "decoded"}, "op10": {"lang_pred", "score"},
}


@pytest.fixture(scope="module")
def operators(spark):
    """Each operator as a function of documents that keeps their columns."""
    docs = spark.createDataFrame([(i, f"bad bad word {i} more text {'vile' if i % 2 else 'kind'} end\nline", "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([(1, "what is the name of the old man by the sea")], "item_id long, text string")
    toxic, rules, langs, vocabulary = toxicity.train(docs, labels), rulefit.train(docs, labels), langid.train(docs), bpe.public_vocabulary()
    return {
        "op1": lambda d: qualityrules.apply_rules(d, limits=qualityrules.Limits(max_docs=2)),
        "op2": lambda d: sharding.assign_shards(d, "doc_id", ["a", "b"], 13),
        "op3": lambda d: toxicity.score_documents(d, toxic),
        "op4": neardup.keep_first,
        "op5": lambda d: decontaminate.clean(d, items),
        "op6": lambda d: d.join(warc.round_trip(d, id_col="doc_id").select(F.col("id").alias("its id")), F.col("its id") == F.col("doc_id")).drop("its id"),
        "op7": lambda d: linededup.dedup_lines(d, min_docs=2),
        "op8": lambda d: rulefit.score_documents(d, rules),
        "op9": lambda d: bpe.encode(d, vocabulary, spread_chars=20, decoded="decoded"),
        "op10": lambda d: langid.identify(d, langs),
    }


@pytest.mark.parametrize("op", RESULTS)
def test_columns_named_like_the_operator_s_own(spark, operators, op):
    assert len(PRIVATE) > 100 and {"_th", "_lost", "_key", "_alone", "_n", "_w", "_t", "host", "digest", "node"} <= set(PRIVATE)
    names = list({n.lower(): n for n in PRIVATE}.values())
    rows = [(1, "one line here\nshared", "s", "en"), (2, "two words\nshared", "s", "en"), (3, "x " * 40 + "\nlast", "t", None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"url": F.lit("u"), "html": F.col("text"), "payload": F.lit("p")})
    clash = plain.select("*", *(F.lit(f"its {n}").alias(n) for n in names if n not in plain.columns), F.lit(1).alias("a `dotted.name`"))
    got = operators[op](clash).collect()
    assert len(got) == 3
    made = RESULTS[op]
    for r in got:
        assert all(r[n] == f"its {n}" for n in names if n not in plain.columns and n not in made)
        assert r["a `dotted.name`"] == 1
    for n in made:
        assert all(r[n] != f"its {n}" for r in got)
    expected = {r["doc_id"]: r for r in operators[op](plain).collect()}
    for r in got:
        assert all(r[n] == expected[r["doc_id"]][n] for n in [*made, "doc_id", "text", "source"])


def test_a_key_named_like_a_result(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, shard string")
    assert sharding.assign_shards(frame, "shard", ["x", "y"], 13).where("shard IN ('x', 'y')").count() == 3
    assert sharding.assign_shards(frame.withColumnRenamed("shard", "slot"), "slot", ["x", "y"], 13).count() == 3


@pytest.mark.parametrize("op", RESULTS)
def test_bytes_that_are_not_utf8(spark, operators, op):
    raw = [(1, b"one \xff two\nshared"), (2, b"\xc3"), (3, b"shared\n\xe2\x82 end " + b"many \xfe words " * 20), (4, b"fine"), (5, None)]
    docs = spark.createDataFrame(raw, "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"), F.lit("s").alias("source"), F.lit("u").alias("url"), F.col("raw").cast("string").alias("html"))
    # text that isn't UTF-8 can't be collected, so its bytes are
    got = operators[op](docs)
    rows = got.withColumns({c: F.col(c).cast("binary") for c, t in got.dtypes if t == "string"}).collect()
    assert len(rows) == 5
    if op == "op9":
        for r in rows:
            whole = bpe._load(bpe.public_vocabulary().data, bpe.public_vocabulary().pattern)[0]
            text = dict(raw)[r["doc_id"]]
            said = (text or b"").decode("utf-8", "replace")
            assert bytes(r["decoded"]) == said.encode() and r["n_tokens"] == len(whole.encode_ordinary(said))
    if op == "op7":
        assert {r["doc_id"]: bytes(r["text"]) for r in rows}[1] == b"one \xff two"
    if op in ("op4", "op5", "op1", "op3", "op8", "op10"):
        assert {r["doc_id"]: None if r["text"] is None else bytes(r["text"]) for r in rows} == dict(raw)


def test_archive_keeps_bytes_that_are_not_utf8(spark):
    frame = spark.createDataFrame([(1, "u", b"\xff\xfe" * 600)], "page_id long, url string, raw binary").select("page_id", "url", F.col("raw").cast("string").alias("html"))
    assert warc.round_trip(frame).first()["payload_digest"] == hashlib.sha1(b"\xff\xfe" * 600).hexdigest()


@pytest.mark.parametrize("op", RESULTS)
def test_no_rows(spark, operators, op):
    none = spark.createDataFrame([], "doc_id long, text string, source string, url string, html string")
    assert operators[op](none).count() == 0
