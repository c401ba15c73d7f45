"""The pipeline on the smallest tables against its stages done by other means."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from rulestream.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage leaves, the input first."""
    docs, out = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out.append((name, docs))
        path = str(tmp_path_factory.mktemp("p") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, ("end", docs)]


def test_columns_and_order(spark, sf_dir, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    columns = table(spark, sf_dir, "documents").columns
    assert all(d.columns == columns for _, d in stages[:-1])
    assert all(d.dtypes == stages[0][1].dtypes for _, d in stages[:-1])


def test_each_stage_takes_effect_and_keeps_the_rest(spark, sf_dir, stages):
    sizes = [d.count() for _, d in stages]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] > 0.5 * sizes[0]
    assert sizes[1] == sizes[2] and sizes[4] == sizes[5]


def test_lines_and_near_copies_by_brute_force(spark, stages):
    before = {r["doc_id"]: r["text"] for r in stages[1][1].collect()}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages[2][1].collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    holders = {}
    for i, t in before.items():
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    for i, t in before.items():
        rest = "\n".join(x for x in t.split("\n") if not (key(x) and len(holders[key(x)]) >= 10))
        assert after[i] == (rest, len(rest)) or (rest == t and after[i][0] == t)
    from test_neardup import brute

    want = sorted({c for _, c in brute([(i, t) for i, (t, _) in after.items()]).values()})
    assert sorted(r["doc_id"] for r in stages[3][1].collect()) == want


def test_the_run_as_a_whole(spark, sf_dir, stages):
    import tiktoken

    vocabulary = corpus_pipeline.public_vocabulary()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.data.splitlines())}
    library = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4][1].collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = np.asarray(library.encode_ordinary(t), "<u4").tobytes()
        assert got[i]["n_tokens"] == len(ids) // 4 and got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
