"""Near-duplicates against brute force, and the parts by themselves."""

import random

import numpy as np
import pytest

from rulestream.llm import neardup
from rulestream.llm.components import components
from rulestream.llm.neardup import BANDS, ROWS, band_keys, cluster, compare_block, keep_first, least_matches, linked, partners, shingles, signature, survivors

SCHEMA = "doc_id long, text string"


def brute(rows):
    """{doc_id: (set size, smallest id reachable)} of rows with distinct ids."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(rng, n, edits, words=120):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_brute_force(spark, seed, monkeypatch):
    """Families with many edits link through chains only, which takes the second round; small blocks make it use several."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(seed)
    texts = [None, "", " \n ", "a b", "A  B", "a b c", "one two three four five", "ONE two\tthree four five", "x" * 5000]
    texts += family(rng, 30, 12) + family(rng, 12, 2) + [f"solo {rng.random()} {rng.random()} a b c d" for _ in range(20)]
    texts += ["same text over and over again here"] * 10
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in cluster(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    kept = sorted(r["doc_id"] for r in keep_first(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == sorted({c for _, c in brute(rows).values()})


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, None), (None, None), (None, "q r")]
    got = sorted(map(str, cluster(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id", "kept").toArrow().to_pylist()))
    row = lambda d, n, c, k: str({"doc_id": d, "n_shingles": n, "component_id": c, "kept": k})
    assert got == sorted([row(None, 2, 7, False), row(7, 2, 7, True), row(7, 2, 7, True), row(3, 0, 3, True), row(None, 0, None, True), row(None, 1, None, True)])
    assert cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    more = spark.createDataFrame([(1, "a b", "x", 2, "n")], "doc_id long, text string, digest string, n int, node string")
    assert keep_first(more).columns == more.columns and keep_first(more).count() == 1


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    first, second, third = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(7, first), (None, first + " more"), (None, second), (None, second + " more"), (8, third), (8, third + " more"), (9, third), (None, None), (None, None), (8, None), (8, " ")]
    got = [(r["doc_id"], r["text"]) for r in keep_first(spark.createDataFrame(rows, SCHEMA)).collect()]
    groups = [(d, "abc".index(t[0]) if (t or "").strip() else t) for d, t in got]
    assert sorted(map(str, groups)) == sorted(map(str, [(7, 0), (None, 1), (8, 2), (None, None), (8, None), (8, " ")]))


def test_components_of_chains_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 50)] + [(a, b) for a in range(500, 508) for b in range(500, 508)] + [(900 - i, 901 - i) for i in range(0, 40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted([list(range(200, 261)), list(range(0, 50)), list(range(500, 508)), list(range(861, 902))])


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    least = least_matches()
    assert [n for n, _ in least] == [32, 64, 96, 128] and all(0 < m < n for n, m in least)
    same = rng.random((20000, 128)) < 0.75
    a = rng.integers(0, 2**32, (20000, 128), dtype=np.uint32)
    b = np.where(same, a, a + 1)
    assert len(survivors(a, b, least)) >= 19990
    far = np.where(rng.random((2000, 128)) < 0.3, a[:2000], a[:2000] + 1)
    assert len(survivors(a[:2000], far, least)) == 0


def test_signatures_estimate_similarity():
    a = shingles(" ".join(f"w{i}" for i in range(1000)).encode())
    b = shingles(" ".join(f"w{i}" for i in range(200, 1200)).encode())
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a) == signature(b)).mean() - true) < 0.15
    assert linked(a, a) and not linked(a, b) and not linked(a[:0], a[:0])


def test_block_links_connect_what_all_pairs_would():
    rng = random.Random(3)
    found = [shingles(t.encode()) for t in family(rng, 25, 10)]
    n = len(found)
    node, comp, role = np.arange(n).repeat(2), np.arange(n).repeat(2), np.tile([0, 1], n)
    links = compare_block(node, comp, role, [f for f in found for _ in (0, 1)], np.ones((n, n), bool))
    want = [(a, b) for a in range(n) for b in range(a) if linked(found[a], found[b])]

    def groups(edges):
        up = list(range(n))
        for a, b in edges:
            a, b = (next(x for x in [v] if True) for v in (a, b))
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        out = {}
        for i in range(n):
            r = i
            while up[r] != r:
                r = up[r]
            out.setdefault(r, set()).add(i)
        return sorted(map(sorted, out.values()))

    assert groups(links) == groups(want) and len(links) < n


def test_each_pair_is_compared_once_and_pruned_by_its_signature():
    rng = random.Random(4)
    sig = np.stack([signature(shingles(t.encode())) for t in family(rng, 40, 14)])
    keys, least, n = band_keys(sig), least_matches(), 40
    seen = {}
    for bucket in {k for ks in keys.tolist() for k in ks}:
        rows = np.flatnonzero((keys == bucket).any(1))
        if len(rows) > 1:
            near = partners(np.concatenate([sig[rows], sig[rows]]), np.tile(rows, 2), np.repeat([0, 1], len(rows)), bucket, least)
            for i, j in zip(*np.nonzero(near)):
                seen[rows[i], rows[j]] = seen.get((rows[i], rows[j]), 0) + 1
    meet = {(i, j) for i in range(n) for j in range(n) if i != j and (sig[i].reshape(BANDS, ROWS) == sig[j].reshape(BANDS, ROWS)).all(1).any() and len(survivors(sig[i : i + 1], sig[j : j + 1], least))}
    assert set(seen) == meet and set(seen.values()) == {1} and meet


def test_hot_components_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 3)
    monkeypatch.setattr(neardup, "HOT_SHARE", 10**9)
    rng = random.Random(6)
    texts = family(rng, 25, 3) + ["one text again and again and again"] * 9 + family(rng, 2, 1) + [None, "x y"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in cluster(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_kept_rows_by_brute_force_with_repeated_and_null_ids(spark):
    """One row for each group of rows that texts link: the first by id (nulls last), then by hash; ids play no part in links."""
    first, second = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    frame = spark.createDataFrame([(3, first), (7, first), (7, second), (None, first)], SCHEMA)
    assert sorted(map(tuple, keep_first(frame).collect())) == [(3, first), (7, second)]
    rng = random.Random(12)
    texts = [t for k in range(4) for t in family(rng, 6, 2)] + [f"solo {k} " + " ".join(f"s{k}_{i}" for i in range(9)) for k in range(6)]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(texts)) for _ in range(60)]
    groups = {t: c for t, (_, c) in zip(texts, (brute(list(enumerate(texts)))[i] for i in range(len(texts))))}
    want = {}
    for d, t in rows:
        key = (d is None, d or 0)
        want[groups[t]] = min(want.get(groups[t], (key, d)), (key, d))
    got = keep_first(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((groups[r["text"]], str(r["doc_id"])) for r in got) == sorted((g, str(d)) for g, (_, d) in want.items())
