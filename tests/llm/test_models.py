"""Classifiers by held-out accuracy on planted data and on the tables; decontamination against brute force; odd inputs."""

import random
import zlib

import numpy as np
import pytest

from rulestream.llm import decontaminate, langid, rulefit, toxicity
from rulestream.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, score string"
ODD = [(None, "a b", "en", "x"), (1, None, "en", "x"), (2, "", None, None), (3, " \n\t ", "en", "x"), (4, "12 !?", "en", "x"), (5, "word " * 40000, "en", "x"), (5, "word " * 40000, "en", "x"), (6, "é", "fr", "x")]


def words(rng, n, extra=()):
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro") for b in ("st", "rd", "n", "l", "mp", "x", "th")]
    return " ".join([rng.choice(pool) for _ in range(n)] + list(extra))


# toxicity


def toxic_rows(rng, n):
    bad = ["foulword", "nastyterm", "vileness"]
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        w = words(rng, rng.randint(20, 200)).split()
        for _ in range(3 * label):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, label, " ".join(w)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(random.Random(1), 400)
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, k, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    held = [(k, got[i]["predicted"]) for i, k, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_never_sees_held_out_labels(spark):
    rows = toxic_rows(random.Random(2), 200)
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    flipped = [(i, 1 - k if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, k, _ in rows]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, k) for i, k, _ in rows], flipped))
    assert np.array_equal(a.weights, b.weights) and a.models == b.models


def brute_models(rows, corpus, rare):
    """Two Kneser-Ney models by hand: {word: log of toxic over ordinary}, and what all other words have."""
    said = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split(" ") if w]
    before = [{}, {}]
    for k, t in rows:
        for line in t.split("\n"):
            for a, w in zip(["", *said(line)], said(line)):
                before[k].setdefault(w, set()).add(a)
    total = [sum(map(len, b.values())) for b in before]
    words = [w for t in corpus for w in said(t)]
    kept = [{w: max(len(v) - rare, 0) / n for w, v in b.items()} for b, n in zip(before, total)]
    back = [1 - sum(k.values()) for k in kept]
    chance = lambda k, w: kept[k].get(w, 0) + back[k] * words.count(w) / len(words)
    found = {w: np.log(chance(1, w) / chance(0, w)) for b in before for w in b if max(len(x.get(w, ())) for x in before) > rare}
    return found, np.log(back[1] / back[0])


def test_models_as_brute_force(spark):
    rows = toxic_rows(random.Random(9), 90)
    rows = [(i, k, t[:60] + "\n" + t[60:] + " Éa 12 b-c") for i, k, t in rows] + [(1000, 1, "same line"), (1001, 0, "other line")]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(5000, "unlabelled foulword text"), (None, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, k) for i, k, _ in rows], "doc_id long, toxic int"))
    mine = [(k, t) for i, k, t in rows if zlib.crc32(str(i).encode()) % 5]
    found, unknown = brute_models(mine, [t for _, _, t in rows] + ["unlabelled foulword text"], toxicity.RARE)
    assert model.models.words.keys() == found.keys() and len(found) > 20
    assert all(model.models.words[w] == pytest.approx(v, abs=1e-9) for w, v in found.items()) and model.models.unknown == pytest.approx(unknown, abs=1e-9)
    text = mine[0][1]
    each = [found.get(w, unknown) for w in toxicity.tokens(text)]
    best = [max(sum(each[i : i + n]) for i in range(max(1, len(each) - n + 1))) / n for n in toxicity.SPANS]
    assert np.allclose(model.models.differences(text), [np.mean(each), *best])


def many_toxic_rows(n):
    """More ordinary rows than any bounded draw of a few thousand takes, with words that few of them hold."""
    rng = random.Random(12)
    rows = [(i, int(i % 10 == 0), words(rng, 5) + f" {'foul' if i % 10 == 0 else 'mild'}{rng.choice('abcdefgh') * 3}{rng.choice('pqrst')}") for i in range(n)]
    return [(i, k, f"{t}\n{rng.choice('xyz')} seldom{'abcdefghijklmnopqrstuvwxyz'[i % 26]}" if i % 97 == 0 else t) for i, k, t in rows]


def test_every_labelled_row_counts(spark):
    rows = many_toxic_rows(6000)
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, k) for i, k, _ in rows], "doc_id long, toxic int"))
    mine = [(k, t) for i, k, t in rows if zlib.crc32(str(i).encode()) % 5]
    assert sum(k == 0 for k, _ in mine) > 4000
    found, unknown = brute_models(mine, [t for _, _, t in rows], toxicity.RARE)
    assert model.models.words.keys() == found.keys()
    assert all(model.models.words[w] == pytest.approx(v, abs=1e-9) for w, v in found.items()) and model.models.unknown == pytest.approx(unknown, abs=1e-9)


def test_joins_by_shuffle_give_the_same_model(spark, monkeypatch):
    rows = toxic_rows(random.Random(4), 120)
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, k, _ in rows], "doc_id long, toxic int")
    a = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    b = toxicity.train(docs, labels)
    assert len(a.models.words) > 20 and a.models == b.models and a.prior == b.prior and np.allclose(a.weights, b.weights)


def test_the_curve_takes_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = (x @ [1, 0.3, 2] + rng.normal(size=700) > 3).astype(float)
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)], "label int, x array<double>").repartition(5)
    w = toxicity.fit_logistic(rows)
    # where the fit ends, the slope over all rows is that of the penalty
    slope = np.column_stack([x, np.ones(700)]).T @ (y - 1 / (1 + np.exp(-(x @ w[:3] + w[3]))))
    spread = x.std(0)
    assert np.allclose((slope[:3] - x.mean(0) * slope[3]) / spread, 0.07 * w[:3] * spread, atol=1e-4) and abs(slope[3]) < 1e-3


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    rows = toxic_rows(random.Random(3), 80)
    model = toxicity.train(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"), spark.createDataFrame([(i, k) for i, k, _ in rows], "doc_id long, toxic int"))
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == {model.prior}
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_toxicity_on_the_table(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    told = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    got = toxicity.score_documents(docs.where(docs["doc_id"].isin(list(told))), model).collect()
    found = sum(r["predicted"] for r in got if told[r["doc_id"]] == 1)
    false = sum(r["predicted"] for r in got if told[r["doc_id"]] == 0)
    assert found >= 0.85 * sum(told[r["doc_id"]] for r in got) and false <= 0.02 * len(got)


# quality


def test_rules_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = QUERIES["op8_rule_ensemble"](spark, d).collect()
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_a_small_sample_keeps_the_share_of_classes(spark):
    # two kinds of documents that statistics tell apart; in one of them three of four are good
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        plain = rng.random() < 0.9
        rows.append((i, int(rng.random() < (0.75 if plain else 0.05)), words(rng, 12, [] if plain else ["###"] * 9)))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").repartition(4).cache()
    labels = spark.createDataFrame([(i, k) for i, k, _ in rows], "doc_id long, quality int")
    whole, part = (np.array([r["score"] for r in rulefit.score_documents(docs, rulefit.train(docs, labels, per_class=n)).orderBy("doc_id").collect()]) for n in (6000, 600))
    assert abs(whole.mean() - part.mean()) < 0.03 and np.mean((whole >= 0.7) == (part >= 0.7)) > 0.9


def test_compiled_rules_score_as_the_model_does(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(1, 60), ["!!!"] * rng.randint(0, 9) + ["###"] * rng.randint(0, 9)) + "\n" * rng.randint(0, 3)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stats = rulefit.with_statistics(docs).orderBy("doc_id").collect()
    x = np.array([[r[f"_q_{k}"] for k in rulefit.STATS] for r in stats])
    ensemble = rulefit.fit(x, (x[:, rulefit.STATS.index("symbols")] < 0.05).astype(float))
    assert 0 < len(ensemble.rules) < 60
    got = [r["score"] for r in rulefit.score_documents(docs, ensemble).orderBy("doc_id").collect()]
    assert np.allclose(got, ensemble.score(x), atol=1e-9)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    none = rulefit.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = rulefit.score_documents(docs, none).collect()
    assert len(got) == len(ODD) and all(r["score"] == pytest.approx(0.5) for r in got)
    assert rulefit.score_documents(docs.limit(0), none).count() == 0


def test_lasso_drops_rules_that_say_nothing():
    rng = np.random.default_rng(1)
    z = (rng.random((500, 12)) < 0.5).astype(float)
    w, b = rulefit.lasso_logistic(z, z[:, 3], 0.05)
    assert w[3] > 1 and np.abs(np.delete(w, 3)).max() < 0.05


# language


def test_languages_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op10_family_then_language"](spark, d).collect()
    held = [langs[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean(held) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)


def test_families_and_odd_rows(spark):
    rng = random.Random(6)
    syllables = {"de": ["sch", "ung", "ein"], "nl": ["ij", "oe", "een"], "fr": ["eau", "oi", "que"], "es": ["ción", "ll", "ar"], "xx": ["qz", "wx", "kk"]}
    made = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(30))
    model = langid.fit([(lang, made(lang)) for lang in syllables for _ in range(25)])
    assert model.families == {"germanic": ["de", "nl"], "romance": ["es", "fr"], "xx": ["xx"]} and set(model.by_pair) == {("de", "nl"), ("es", "fr")}
    assert np.mean([model.predict(made(lang))[0] == lang for lang in syllables for _ in range(20)]) > 0.97
    docs = spark.createDataFrame(ODD, DOCS)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5] in syllables
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit([])).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    long = made("fr") * 20000
    assert model.predict(long)[0] == "fr"


# decontamination


def brute_hits(docs, items, size=8, least=6):
    """Documents with items whose template windows occur in them; for texts of literal words only."""
    out = set()
    bare = lambda t: [w.strip(decontaminate.MARKS).lower() for w in (t or "").split()]
    for d, t in docs:
        w = bare(t)
        there = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        for i, u in items:
            v = bare(u)
            wanted = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)}
            if wanted and len(wanted & there) >= min(least, len(wanted)):
                out.add((d, i))
    return out


def test_literal_passages_as_brute_force(spark):
    rng = random.Random(7)
    items = [(i, words(rng, 30) + ".") for i in range(6)]
    docs = [(100 + k, words(rng, 50) + " " + (items[k % 6][1] if k % 3 == 0 else "") + " " + words(rng, 50)) for k in range(30)]
    got = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute_hits(docs, items)


QUESTION = "{0} walked with {1} for {2} km and later bought {3} apples for {4} dollars at the store near home, then {0} slept."


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_other_values_are_caught_if_consistent(spark, limit):
    items = spark.createDataFrame([(1, "Today " + QUESTION.format("Eve", "Finn", 1, 2, 8)), (2, None), (3, "hm"), (1, "Today " + QUESTION.format("Eve", "Finn", 1, 2, 8))], "item_id long, text string")
    docs = [(1, "Yesterday " + QUESTION.format("Carla", "Dirk", 9, 40, 7), "k"), (2, "Yesterday " + QUESTION.format("Carla", "Dirk", 9, 40, 7).replace("then Carla", "then Dirk"), "k"), (3, "Today " + QUESTION.format("Eve", "Finn", 1, 2, 8), "k"), (4, None, "k"), (None, "", "k"), (5, "Yesterday nobody walked anywhere at all and the shop was closed for the day", "k")]
    frame = spark.createDataFrame(docs + [docs[0]], "doc_id long, text string, key string")
    got = {(r["doc_id"], r["item_id"], r["same_values"]) for r in decontaminate.find_contaminated(frame, items, broadcast_windows=limit).collect()}
    assert got == {(1, 1, False), (3, 1, True)}
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(frame, items, broadcast_windows=limit).collect()) == ["2", "4", "5", "None"]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_copies_with_other_marks_and_capitals(spark, limit):
    item = "The old mill stands by the river. Every spring Eve paints the doors of the mill. Nobody knows when Finn built it or why he left the valley so soon."
    forms = {1: item, 2: item.replace(".", ""), 3: item.replace(".", ","), 4: item.title(), 5: item.upper(), 6: "Every spring the old mill stands by the river. Nobody knows the doors of the valley."}
    docs = spark.createDataFrame([(k, f"so it was\n{t}\nand so on") for k, t in forms.items()], "doc_id long, text string")
    found = decontaminate.find_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), broadcast_windows=limit).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 4, 5}
    assert all(0 < r["n_matched"] <= r["n_windows"] and r["same_values"] for r in found)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_items_of_few_literals_match_with_their_own_values(spark, limit):
    items = [(1, "What is 3 + 4 ?"), (2, "3 7 12 25 31 48 50 66 72 81 90 105"), (3, "Winners: Ann Bob Carla Dirk Eve Finn Gus Hal Ida Jim"), (4, "... ?!")]
    others = ["What is 5 + 9 ?", "1 2 3 4 5 6 7 8 9 10 11 12", "Winners: Jim Ida Hal Gus Finn Eve Dirk Carla Bob Ann"]
    docs = [(k, f"so it was\n{t}\nand so on") for k, t in items] + [(10 + k, f"so it was\n{t}\nand so on") for k, t in enumerate(others)]
    found = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=limit)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 1), (2, 2), (3, 3)}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_one_conflict_does_not_hide_the_rest(spark, limit):
    rest = "the keeper counts the boats in the harbour and writes the number into a thick green book that nobody else may read or carry away"
    named = "Once Eve and her aunt came by, " + rest + ", until at last Eve went home with the book."
    sums = "A shop sells {} red pens and a few blue ones, while its owner sits behind a wooden table all morning and reads about distant islands, then it sells {} green pens to a school far away in the hills."
    docs = [(1, named.replace("last Eve", "last Finn")), (2, sums.format(5, 7)), (3, sums.format(8, 9)), (4, sums.format(8, 8)), (5, "Once Ann came by, then she sold 5 red pens and 7 green ones to a school.")]
    items = [(1, named), (2, sums.format(5, 5)), (3, "He had {0} eggs in a box and {0} more eggs in the other box at home.".format(6))]
    docs += [(6, "He had 2 eggs in a box and 3 more eggs in the other box at home.")]
    found = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=limit)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 1), (2, 2), (3, 2), (4, 2), (6, 3)}


def test_tokens_and_kinds():
    text = decontaminate.Templates().read("The car went 5km. Then Bob, aged 7, ran 10 % of 3.5 miles\nSo did he | and Ann")
    assert [(t.strip(decontaminate.MARKS), int(k)) for t, k in zip(text.tokens, text.kind) if k] == [("5", 1), ("km", 3), ("Bob", 2), ("7", 1), ("10", 1), ("", 3), ("3.5", 1), ("miles", 3), ("Ann", 2)]
    text = decontaminate.Templates().read("Ann met Mary Ann Lee, Bob's twenty five or twenty-one owls, and Bob Bob. Bob fled.")
    assert decontaminate.slots(text, 0, len(text.start)) == ["N:ann", "N:mary ann lee", "N:bob", "n:20 5", "n:20 1", "N:bob bob", "N:bob"]


def plain_hits(docs, items, window=8, least=6):
    """Documents that hold an item in other words and with other values, by comparing every place of one with every place of the other.

    For texts of one form: single spaces, marks only after words, names inside sentences.
    """
    number = set(decontaminate.NUMBERS)

    def read(text):
        out, begin = [], True
        for at, word in enumerate(text.split(" ")):
            bare = word.strip(".,?")
            kind = "n" if bare.isdigit() or bare in number else "N" if bare[:1].isupper() and not begin else ""
            value = decontaminate.NUMBERS.get(bare, bare.lower())
            begin = word[-1] in ".?"
            if kind and out and out[-1][0] == kind and not out[-1][2] and (kind == "N" or bare in number):
                out[-1] = (kind, out[-1][1] + " " + value, word[-1] in ".,?", out[-1][3])
            else:
                out.append((kind, value, word[-1] in ".,?", at))
        return out, [w.strip(".,?").lower() for w in text.split(" ")]

    hits = set()
    for d, t in docs:
        for i, u in items:
            (a, la), (b, lb) = read(t), read(u)
            there = {tuple(la[k : k + window]) for k in range(len(la) - window + 1)}
            matched = {p for p in range(len(lb) - window + 1) if tuple(lb[p : p + window]) in there}
            same = lambda x, y: x[0] == y[0] and (x[0] or x[1] == y[1])
            for shift in range(-len(b), len(a)):
                at = [p for p in range(len(b) - window + 1) if 0 <= p + shift <= len(a) - window and all(same(a[p + shift + j], b[p + j]) for j in range(window))]
                at = [p for p in at if 4 <= sum(not k for k, *_ in b[p : p + window]) < window]
                names = {(b[p + j][1], a[p + shift + j][1]) for p in at for j in range(window) if b[p + j][0] == "N"}
                if len({x for x, _ in names}) == len({y for _, y in names}) == len(names):
                    matched |= {b[p][3] for p in at}
            if len(matched) >= min(least, (len(lb) - window + 1) / 2) > 0:
                hits.add((d, i))
    return hits


def test_templates_as_brute_force(spark):
    rng = random.Random(11)
    people, sums = ["Eve", "Finn", "Mary Ann", "Bob", "Dirk Jan", "Ida"], ["3", "14", "five", "twenty one", "120", "two"]
    items, docs = [], []
    for i in range(8):
        frame = [words(rng, 9) + " {a}", "and {b} " + words(rng, 3), "took {m} " + words(rng, 7), "from {a} " + words(rng, 6) + " {n} " + words(rng, 8) + "."]
        fill = lambda a, b: " ".join(frame).format(a=a, b=b, m=rng.choice(sums), n=rng.choice(sums))
        pair = rng.sample(people, 2)
        items.append((i, "it " + fill(*pair)))
        for k in range(4):
            other = rng.sample(people, 2) if k < 3 else ["Bob", "Bob"]
            docs.append((10 * i + k, words(rng, 20) + " " + fill(*other) + " " + words(rng, 20)))
        docs.append((10 * i + 4, words(rng, 40)))
    want = plain_hits(docs, items)
    got = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) >= 20


def test_short_items_names_of_several_words_and_one_to_one_names(spark):
    question = "Once {0} and {1} carried {2} baskets of plums over the hill to the market and sold them to a miller who gave {0} a coat."
    items = [(1, "Yes"), (2, question.format("Eve", "Finn", "five"))]
    docs = [(1, "yes it was so"), (2, question.format("Mary Ann", "Finn", "3")), (3, question.format("Bob", "Bob", "six")), (4, question.format("Ida", "Jo", "twenty two")), (5, "Yes")]
    got = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found - {(3, 2)} == {(2, 2), (4, 2)}
    # with other values in every window, two names that stand for one say that it is another text
    close = "At noon {0} lent {1} the red cart, then {0} told {1} of the old well, and {1} gave {0} bread."
    got = decontaminate.find_contaminated(spark.createDataFrame([(1, close.format("Bob", "Bob")), (2, close.format("Ida", "Jo"))], "doc_id long, text string"), spark.createDataFrame([(1, close.format("Eve", "Finn"))], "item_id long, text string"))
    assert [r["doc_id"] for r in got.collect()] == [2]


def test_of_two_texts_with_one_id_the_closer_one_is_reported(spark):
    item = " ".join(f"w{chr(97 + i)}" for i in range(24))
    docs = spark.createDataFrame([(1, item), (1, item[:45]), (None, item), (None, item[:45])], "doc_id long, text string")
    got = decontaminate.find_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_matched"]) for r in got) == [("1", 17), ("None", 17)]


def test_nothing_to_compare(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contaminated(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == 1
    assert decontaminate.find_contaminated(docs.limit(0), none).count() == 0
