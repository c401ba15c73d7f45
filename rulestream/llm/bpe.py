"""Byte-level BPE by overlapping chunks.

A text is cut into chunks of ``chunk_chars`` that reach ``overlap_chars`` into both neighbours, and
each chunk is pre-tokenised on its own. A chunk starts at an arbitrary place, so its first
pre-tokens may be wrong until its boundaries fall in step with those of the text. Each chunk encodes
the pre-tokens from its first boundary at or after its own start to its first boundary at or after
the next chunk's start. Where the end of one chunk is the begin of the next, the two have fallen in
step: from a true boundary on, the pre-tokeniser has one course only. A text whose chunks don't all
meet (such as one endless word) is encoded in one piece instead. Decoding concatenates the bytes of
the ids. The chunks of a text of more than ``spread_chars`` are as large as that and go to different
tasks; those of others are encoded one after another where the text lies.

Defined results: a null or empty text gives no ids. Bytes that aren't UTF-8 are encoded as U+FFFD.
Rows are independent, so repeated rows give repeated results, and rows with a null doc_id are
encoded as any other. An empty table gives an empty table. Input columns pass through; ``ids``
(little-endian unsigned 32-bit integers) and ``n_tokens`` replace columns of the same name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulestream.llm.common import add_columns, col, free, valid, without

CHUNK_CHARS = 4_096
OVERLAP_CHARS = 256
SPREAD_CHARS = 32_768


class Vocabulary:
    """Ranks and pattern; small enough to travel with each task (the rank file's size is checked)."""

    def __init__(self, rank_file: str, pattern: str, most_bytes: int = 32 << 20):
        self.data = open(rank_file, "rb").read()
        if len(self.data) > most_bytes:
            raise ValueError(f"the rank file has {len(self.data)} bytes, more than {most_bytes}")
        self.pattern = pattern


@lru_cache(maxsize=2)
def _load(data: bytes, pattern: str) -> tuple[tiktoken.Encoding, "regex.Pattern", list[bytes]]:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding, regex.compile(pattern), tokens


def _pack(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def encode_chunk(loaded, text: str, begin: int, end: int, last: bool) -> tuple[int, int, bytes]:
    """Of a chunk's text: its first boundary at or after ``begin``, at or after ``end``, and the ids between.

    ``begin`` 0 is the start of the whole text. A boundary that the chunk doesn't have is -1. The
    chunk's own end is a boundary only where the whole text ends (``last``).
    """
    encoding, pattern, _ = loaded
    # a run of white space is split by what follows it, so only ends of words and numbers serve as cuts;
    # where the chunk goes on, its last two pre-tokens aren't settled
    ends = [m.end() for m in pattern.finditer(text)]
    cuts = [c for c in (ends if last else ends[:-2]) if text[c - 1].isalnum()]
    first = 0 if begin == 0 else next((c for c in cuts if c >= begin), -1)
    stop = len(text) if last else next((c for c in cuts if c >= end), -1)
    if first < 0 or stop < first:
        return -1, -1, b""
    return first, stop, _pack(encoding.encode_ordinary(text[first:stop]))


def encode_text(loaded, text: str, size: int, overlap: int) -> bytes:
    """The ids of a text, chunk by chunk; in one piece if the chunks don't meet."""
    parts, reached, n = [], 0, len(text)
    for begin in range(0, n if n > size else 0, size):
        low, end = max(0, begin - overlap), min(begin + size, n)
        first, stop, ids = encode_chunk(loaded, text[low : end + overlap], begin - low, end - low, end == n)
        if first < 0 or low + first != reached:
            parts = []
            break
        parts.append(ids)
        reached = low + stop
    return b"".join(parts) if parts else _pack(loaded[0].encode_ordinary(text))


def encode(docs: DataFrame, vocabulary: Vocabulary, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, spread_chars: int = SPREAD_CHARS, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens``, and with the decoded bytes if a name is given for them.

    A column ``decoded`` is made from the ids, in the same pass over the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.data, vocabulary.pattern))
    docs = without(docs, "ids", "n_tokens", *[decoded] * bool(decoded))
    is_long = F.coalesce(F.length(valid()), F.lit(0)) > spread_chars
    work = lambda: _whole(shared.value, chunk_chars, overlap_chars, bool(decoded))
    short = add_columns(docs.where(~is_long), _fields(decoded), valid(), work)
    long = _encode_long(docs.where(is_long), shared, spread_chars, overlap_chars, decoded, work)
    return short.unionByName(long).withColumn("n_tokens", F.expr("octet_length(ids) div 4"))


def _fields(decoded: str | None) -> str:
    return "ids binary" + (f", `{decoded}` binary" if decoded else "")


def _whole(value, size: int, overlap: int, back: bool):
    """Ids of texts that stay in one task, and their bytes again if ``back``."""
    loaded = _load(*value)

    def work(texts: list[bytes | None]) -> list[list]:
        packed = [encode_text(loaded, t.decode(), size, overlap) if t else b"" for t in texts]
        return [packed, [_unpack(loaded, x) for x in packed]] if back else [packed]

    return work


def _unpack(loaded, ids: bytes) -> bytes:
    return b"".join(map(loaded[2].__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encode_long(docs: DataFrame, shared, size: int, overlap: int, decoded: str | None, whole) -> DataFrame:
    """The long texts: chunks over all tasks, joined up again by the text's digest."""
    key, found, back, alone = free(docs, "_key", "_ids", "_back", "_alone")
    keyed = docs.withColumn(key, F.sha2(valid(), 256))
    starts = F.sequence(F.lit(0), F.ceil(F.length("text") / size).cast("int") - 1)
    begin = F.col("k") * size
    low = F.greatest(begin - overlap, F.lit(0))
    end = F.least(begin + size, F.col("n"))
    texts = keyed.select(F.col(key).alias("_key"), valid().alias("text")).dropDuplicates(["_key"])
    pieces = texts.select("_key", "text", F.length("text").alias("n"), F.explode(starts).alias("k"))
    piece = F.substring("text", low + 1, F.least(end + overlap, F.col("n")) - low)
    pieces = pieces.select("_key", "k", low.alias("low"), (begin - low).alias("begin"), (end - low).alias("end"), (end == F.col("n")).alias("last"), piece.alias("text")).repartition("_key", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _load(*shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                low, begin, end, last, text = (part.column(c)[0].as_py() for c in ("low", "begin", "end", "last", "text"))
                first, stop, ids = encode_chunk(loaded, text, begin, end, last)
                places = (low + first if first >= 0 else -1, low + stop if stop >= 0 else -2)
                again = _unpack(loaded, ids) if decoded else b""
                yield pa.RecordBatch.from_pydict({"_key": part.column("_key"), "k": part.column("k"), "first": pa.array(places[:1], pa.int64()), "stop": pa.array(places[1:], pa.int64()), "ids": pa.array([ids], pa.binary()), "back": pa.array([again], pa.binary())})

    coded = pieces.mapInArrow(run, "_key string, k int, first bigint, stop bigint, ids binary, back binary")
    parts = coded.groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("k", "first", "stop"))).alias("p"),
        F.expr("listagg(ids, X'') WITHIN GROUP (ORDER BY k)").alias(found),
        F.expr("listagg(back, X'') WITHIN GROUP (ORDER BY k)").alias(back),
    )
    met = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (F.get("p", i)["first"] >= 0) & ((i == 0) | (F.get("p", i)["first"] == F.get("p", i - 1)["stop"])))
    # what didn't meet is encoded in one piece
    stitched = keyed.join(parts.where(met).select(F.col("_key").alias(key), found, back), key, "left").withColumn(alone, F.when(F.col(found).isNull(), valid())).drop(key)
    made = add_columns(stitched, _fields(decoded), alone, whole).withColumn("ids", F.coalesce(found, "ids"))
    return (made.withColumn(decoded, F.coalesce(F.col(back), col(decoded))) if decoded else made).drop(found, back, alone)


def decode(coded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of ``ids`` concatenated; null ids give no bytes."""
    shared = coded.sparkSession.sparkContext.broadcast((vocabulary.data, vocabulary.pattern))

    def fill():
        loaded = _load(*shared.value)
        return lambda values: [[_unpack(loaded, x or b"") for x in values]]

    return add_columns(coded, f"`{into}` binary", ids, fill)


def public_vocabulary(spark: SparkSession | None = None, name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    """A vocabulary of the installed public tokenizers, read on the driver."""
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)
