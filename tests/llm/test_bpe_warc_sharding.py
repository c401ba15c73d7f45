"""Encoding against the library it must agree with, archive round trips, and shard tables against a plain version."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from rulestream.llm import bpe, sharding, warc


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.data.splitlines())}
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})


def test_chunks_as_the_library(spark, vocabulary, library):
    rng = random.Random(3)
    parts = ["a", "bc", "  ", " ", "\n", "\t", "é", "日本", "1", "23", "'s", "...", "😀", "#", "word", " the", " ", "\x1c", "<|endoftext|>", " "]
    texts = [None, "", "   ", "x" * 3000, " " * 3000, "ab " * 1500] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 1500))) for _ in range(120)]
    rows = [(i, t, "keep") for i, t in enumerate(texts)] + [(3, "x" * 3000, "twice"), (None, "abc  d " * 500, "null")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(frame, vocabulary, chunk_chars=100, overlap_chars=40, spread_chars=400, decoded="back").collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode_ordinary(r["text"] or "")
        assert bytes(r["ids"]) == np.asarray(want, "<u4").tobytes() and r["n_tokens"] == len(want)
        assert bytes(r["back"]) == (r["text"] or "").encode()
    assert {bytes(r["decoded"]) for r in bpe.decode(bpe.encode(frame, vocabulary), vocabulary).collect()} == {(t or "").encode() for _, t, _ in rows}
    assert bpe.encode(frame.limit(0), vocabulary).count() == 0


def test_query_on_the_table(spark, sf_dir, library):
    from rulestream.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op9_byte_bpe"](spark, sf_dir).collect():
        ids = np.asarray(library.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


PAGES = "page_id long, url string, html string, payload string"


def parse(data):
    """The records of an uncompressed archive file, by the letter of the format: (fields, block)."""
    out, at = [], 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines)
        assert len(fields) == len(lines) and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= set(fields)
        size = int(fields["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        assert data[stop + 4 + size : stop + 8 + size] == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and re.fullmatch(r"<urn:[^\s<>]+>", fields["WARC-Record-ID"])
        out.append((fields, block))
        at = stop + 8 + size
    return out


@pytest.mark.parametrize("limit", [warc.BROADCAST_COPIES, 0])
def test_archive(spark, tmp_path, limit):
    big = "é" * 600
    rows = [(1, "http://a/\r\nX: y", big, "p"), (2, "http://b", big, None), (9, None, big, None), (3, "u", None, None), (4, "u", "", None), (5, "u", "small", None), (6, "u", "small", None), (None, "u", big, None), (9, "v", big, None), (7, "u", "WARC/1.1\r\n\r\n" * 100, None)]
    pages = spark.createDataFrame(rows, PAGES)
    archive = warc.write_archive(pages, warc.new_archive(spark), broadcast_copies=limit)
    read = warc.read_archive(spark, archive)
    assert spark.read.parquet(archive.payloads).count() == 4 and read.count() == len(rows)
    told = sorted(map(tuple, warc.describe(warc.records(read), "bigint").select("id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    assert told == sorted([(1, 1200, "revisit", 9), (2, 1200, "revisit", 9), (9, 1200, "response", None), (9, 1200, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (None, 1200, "response", None), (7, 1200, "response", None)], key=str)
    made = sorted(bytes(r["record"]) for r in warc.records(read).collect())
    warc.export_warc(read, str(tmp_path / "w"))
    files = [gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz"))]
    found = [x for f in files for x in parse(f)]
    assert sorted(b"".join(files)) == sorted(b"".join(made)) and sorted(x for m in made for x in map(str, parse(m))) == sorted(map(str, found))
    assert len({f["WARC-Record-ID"] for f, _ in found}) == len(rows)
    payloads = sorted((t or "").encode() for _, _, t, _ in rows)
    responses = {f["WARC-Record-ID"]: b for f, b in found if f["WARC-Type"] == "response"}
    assert sorted(b or responses.get(f.get("WARC-Refers-To"), b"") for f, b in found) == payloads
    assert all(b == b"" for f, b in found if f["WARC-Type"] == "revisit")
    assert {f["WARC-Target-URI"] for f, _ in found} == {"http://a/%0D%0AX:%20y", "http://b", "about:blank", "u", "v"}
    assert warc.round_trip(pages.limit(0)).count() == 0
    archive.delete(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(archive.payloads)


def test_text_ids(spark):
    pages = spark.createDataFrame([("a:b >", "u", "x" * 2000), ("ä", "u", "x" * 2000), ("", "u", "y")], "page_id string, url string, html string")
    assert sorted(map(tuple, warc.round_trip(pages).select("id", "record_type", "refers_to").collect()), key=str) == sorted([("a:b >", "revisit", "ä"), ("ä", "response", None), (None, "response", None)], key=str)


def test_a_changed_payload_is_found(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "abc", None)], PAGES), warc.new_archive(spark))
    spark.read.parquet(archive.payloads).withColumn("payload", F.lit(b"abd")).write.parquet(archive.folder + "/bad/payloads")
    spark.read.parquet(archive.headers).write.parquet(archive.folder + "/bad/headers")
    with pytest.raises(Exception, match="the stored payload isn't"):
        warc.read_archive(spark, warc.Archive(archive.folder + "/bad")).select("payload_digest", "sha256").collect()


def plain_table(shards, size):
    """Preference lists written out in full."""
    lists = []
    for s in shards:
        offset, skip = sharding.preference(s, size)
        lists.append([(offset + j * skip) % size for j in range(size)])
    owner, nexts = {}, [0] * len(shards)
    while len(owner) < size:
        for i, s in enumerate(shards):
            while lists[i][nexts[i]] in owner:
                nexts[i] += 1
            owner[lists[i][nexts[i]]] = s
            if len(owner) == size:
                break
    return [owner[j] for j in range(size)]


def test_shard_tables():
    for shards, size in ((["a", "b", "c"], 13), ([f"s{i}" for i in range(7)], 101), (["one"], 2)):
        assert sharding.fill_table(shards, size) == plain_table(shards, size)
    shards = [f"s{i}" for i in range(20)]
    before, after = sharding.fill_table(shards, 5003), sharding.fill_table(shards[:-1], 5003)
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sum(a != b for a, b in zip(before, after) if a != "s19") < 0.1 * 5003
    for bad in ((["a"], 12), ([], 13), (["a", "a"], 13)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_placement(spark, sf_dir):
    from rulestream.llm.queries import QUERIES, SHARDS

    owners = sharding.fill_table(SHARDS)
    rows = QUERIES["op2_lookup_sharding"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        slot = int(hashlib.md5(f"k{r['doc_id']}".encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, owners[slot])
    odd = spark.createDataFrame([(None, 1), ("", 2), ("x", 3), ("x", 4)], "k string, slot int")
    placed = {r["slot"] for r in sharding.assign_shards(odd, "k", ["a", "b"], 13).collect()}
    assert len(placed) <= 3 and sharding.assign_shards(odd, "k", ["a", "b"], 13).count() == 4
    assert sharding.assign_shards(odd.limit(0), "k", ["a", "b"], 13).count() == 0
