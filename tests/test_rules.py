import re

import pytest
from pyspark.sql import functions as F

from rulestream.catalogs.rules import RULES
from rulestream.functions.text import LINE_END, entropy, matches, snippet, split_lines
from rulestream.operators import rules


def test_catalogue():
    assert len(RULES) == 90 and len({r.id for r in RULES}) == 90
    assert sum(not r.languages for r in RULES) == 15 and sum(bool(r.negatives) for r in RULES) == 19


def test_each_rule_fires_on_its_sample_and_not_on_a_neutral_line(spark):
    rows = [(r.id, r.languages[0] if r.languages else "yaml", r.sample) for r in RULES]
    files = spark.createDataFrame([(f"{i}.x", language, text) for i, language, text in rows], "path string, language string, content string")
    fired = {(r["path"][:-2], RULES[r["rule_ord"]].id) for r in rules.rule_matches(files).select("path", "rule_ord").collect()}
    assert {(r.id, r.id) for r in RULES} <= fired
    calm = spark.createDataFrame([("a", language, "value = compute(value)") for _, language, _ in rows], "path string, language string, content string")
    assert rules.rule_matches(calm).count() == 0


TEXTS = ["", "one", "x = eval(a)", "\neval(a)\n\n eval(b) eval(c)\n", "a\r\neval(x)\r\n", "é eval(ü)\neval(", "# eval(a)", "// eval(b)", "x\u2028eval(z)\n"]


def test_match_positions_as_an_independent_search_finds_them(spark):
    pattern = r"\beval\("
    got = {(r["t"], m["k"]): (m["line_start"], m["line_end"], m["col_start"], m["text"]) for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", matches(F.col("t"), pattern).alias("m")).collect() for m in r["m"]}
    want = {}
    for t in TEXTS:
        for k, m in enumerate(re.finditer("(?im)" + pattern, t)):
            before = t[: m.start()]
            want[t, k] = (before.count("\n") + 1, before.count("\n") + 1, m.start() - (before.rfind("\n") + 1), m.group())
    assert got == want


@pytest.mark.parametrize("text", TEXTS + ["a\n\nb", "a\rb\x0bc\x0cd\x1ce\x85f\u2029g", "\n", "\r\n"])
def test_lines_as_python_splits_them(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(split_lines(F.col("t"))).first()[0] == text.splitlines()
    assert re.compile(LINE_END)


def fires(spark, rule_id, content, language="python"):
    rule = [r for r in RULES if r.id == rule_id]
    rows = rules.rule_matches(spark.createDataFrame([("f", language, content)], "path string, language string, content string"), rule)
    return [r["line_start"] for r in rows.select("line_start").orderBy("line_start").collect()]


def test_comments_are_skipped_but_not_trailing_ones(spark):
    assert fires(spark, "PY_CMDI_004", "# exec(a)\n  // exec(b)\nexec(c)") == [3]
    assert fires(spark, "UNIV_TODO_001", "# TODO fix auth\nrun() # TODO fix auth") == [2]


@pytest.mark.parametrize("gap,lines", [(2, []), (3, [5])])
def test_suppression_reaches_three_lines(spark, gap, lines):
    assert fires(spark, "PY_DESER_002", "SafeLoader" + "\n" * 3 + "x\n" + "yaml.load(t)") == [5]
    text = "SafeLoader\n" + "x\n" * gap + "yaml.load(t)"
    assert fires(spark, "PY_DESER_002", text) == lines


def test_a_rule_without_languages_takes_unknown_files(spark):
    assert fires(spark, "IAC_K8S_001", "privileged: true", None) == [1]
    assert fires(spark, "PY_CMDI_004", "exec(c)", None) == []


def test_snippet_clips_and_marks(spark):
    row = spark.createDataFrame([(["a", "b", "c", "d"],)], "l array<string>")
    assert row.select(snippet(F.col("l"), F.lit(1), F.lit(1))).first()[0] == ">>>    1 | a\n       2 | b\n       3 | c"
    assert row.select(snippet(F.col("l"), F.lit(4), F.lit(9))).first()[0] == "       2 | b\n       3 | c\n>>>    4 | d"


def test_entropy(spark):
    got = [r[0] for r in spark.createDataFrame([("aabbcd",), ("aaaa",), ("",)], "t string").select(F.round(entropy(F.col("t")), 3)).collect()]
    assert got == [1.918, 0.0, 0.0]
