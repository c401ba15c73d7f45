"""Line dedup and quality rules: odd inputs, and a brute-force version."""

import re

import pytest

from rulestream.llm.linededup import dedup_lines
from rulestream.llm.qualityrules import Limits, apply_rules

SCHEMA = "doc_id long, text string, source string"
ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n\n X  \nx", "a"), (4, "A\n" * 3, None), (None, "A\nb", "a"), (None, "A\nc", "b"), (5, "a\r\nÄ\nä", "a"), (5, "a\r\nÄ\nä", "a"), (6, "w " * 30000, "b"), (7, "é a a", "b")]


def brute_dedup(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    holders = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        rest = [x for x in lines if not (key(x) and len(holders[key(x)]) >= least)]
        out.append((i, "\n".join(rest), len(lines), len(lines) - len(rest)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 3])
def test_dedup_as_brute_force(spark, least):
    got = dedup_lines(spark.createDataFrame(ODD, SCHEMA), min_docs=least)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"] or set(got.columns) == {"doc_id", "text", "source", "n_lines", "n_dropped"}
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == brute_dedup(ODD, least)


def test_dedup_of_nothing_and_with_clashing_columns(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "x", 9, "k", 1, "p")], "doc_id long, text string, n_lines int, key string, pos int, _lost string")
    row = dedup_lines(clash.drop("_lost")).first()
    assert (row["n_lines"], row["key"], row["pos"]) == (1, "k", 1)


def brute_rules(rows, limits):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    norm = lambda x: " ".join(words(x.lower()))
    holders = {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            holders.setdefault((s, norm(x)), set()).add(i)
    out = []
    for i, t, s in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        seen = {}
        for x in windows:
            seen[x] = seen.get(x, 0) + 1
        covered = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(8)}
        gone = sum(len(words(x)) for x in lines if len(holders[s, norm(x)]) >= limits.max_docs)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        left = len(w) - gone
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed, not failed and left >= 0.5 * len(w), gone))
    return sorted(out, key=str)


def test_rules_as_brute_force(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = ODD + [(10 + i, f"{text}\nextra {i} one two\n#*$ <x>", "h") for i in range(4)] + [(20, text + " " + text, "h"), (21, text + "\n" + "b " * 5, "g"), (22, "\n".join(["l one two"] * 9), "g")]
    limits = Limits(max_docs=3)
    got = apply_rules(spark.createDataFrame(rows, SCHEMA), limits=limits)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == brute_rules(rows, limits)


def test_rules_of_nothing_and_with_clashing_columns(spark):
    assert apply_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    row = apply_rules(spark.createDataFrame([(1, "a", "s", 5, "z")], "doc_id long, text string, source string, n_words int, host string")).first()
    assert row["n_words"] == 1 and row["host"] == "z"
