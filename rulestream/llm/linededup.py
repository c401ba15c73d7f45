"""Line dedup: drop lines that many documents share, keep the rest in order.

Lines are normalised (ASCII white space stripped at both ends, A-Z lower-cased), hashed to 128
bits and exploded as (key, document). Keys found in ``min_docs`` distinct documents lose their
lines everywhere. Only hashes and positions are shuffled for the decision; the text is touched
again when each document is put together from the positions that remain.

Defined results: a null or empty text is one empty line, and the result's text is then empty. Lines
are compared and kept byte by byte, also where they aren't UTF-8.
Rows that share a doc_id count as one document; rows with a null doc_id together count as one.
Repeated rows are each kept, with the same result. An empty table gives an empty table. Input
columns other than ``doc_id`` and ``text`` pass through; ``n_lines`` and ``n_dropped`` replace
columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulestream.llm.common import WS_BYTES, add_columns, byte_texts, col, cut, free, text_hash, type_of


def line_keys(text: bytes) -> list[bytes]:
    """The normalised lines of a text."""
    return [line.strip(WS_BYTES).lower() for line in text.split(b"\n")]


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _explode(docs: DataFrame, min_chars: int, positions: bool) -> DataFrame:
    """(doc_id, key), each once per row; with ``positions`` also the row's hash and the line's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys, places = [], [], []
            for i, text in enumerate(byte_texts(batch.column("text"))):
                lines = line_keys(text)
                for pos, line in enumerate(lines) if positions else ((0, x) for x in set(lines)):
                    if len(line) >= min_chars and (min_chars < 2 or len(line.decode("utf-8", "replace")) >= min_chars):
                        row.append(i)
                        keys.append(_digest(line))
                        places.append(pos)
            taken = pa.array(row, pa.int64())
            columns = {"doc_id": batch.column("doc_id").take(taken), "key": pa.array(keys, pa.binary())}
            if positions:
                columns |= {"_th": batch.column("_th").take(taken), "pos": pa.array(places, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)

    names = ["doc_id", "text"] + ["_th"] * positions
    schema = f"doc_id {type_of(docs, 'doc_id')}, key binary" + ", _th bigint, pos int" * positions
    return docs.select(*names).mapInArrow(run, schema)


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(key, n_docs) of the line keys that at least ``min_docs`` distinct documents hold."""
    pairs = _explode(docs, min_chars, positions=False).dropDuplicates(["key", "doc_id"])
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text``, and n_lines and n_dropped."""
    frequent = cut(frequent_lines(docs, min_docs, min_chars)).select("key")
    th, lost_id, lost_th, gone = free(docs, "_th", "_lost_id", "_lost_th", "_lost")
    lost = (
        _explode(docs.select("doc_id", "text", text_hash().alias("_th")), min_chars, positions=True)
        .join(frequent, "key", "left_semi")
        .groupBy("doc_id", "_th")
        .agg(F.collect_set("pos").alias(gone))
        .select(F.col("doc_id").alias(lost_id), F.col("_th").alias(lost_th), gone)
    )

    def rebuild(texts: list[bytes | None], lost: list[list[int] | None]) -> list[list]:
        kept, n_lines, n_dropped = [], [], []
        for text, places in zip(texts, lost):
            lines = (text or b"").split(b"\n")
            drop = set(places or ())
            rest = [x for i, x in enumerate(lines) if i not in drop] if drop else lines
            kept.append(b"\n".join(rest))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(rest))
        return [kept, n_lines, n_dropped]

    keyed = docs.withColumn(th, text_hash())
    same = keyed["doc_id"].eqNullSafe(F.col(lost_id)) & keyed[th].eqNullSafe(F.col(lost_th))
    joined = keyed.join(lost, same, "left").drop(lost_id, lost_th, th)
    made = add_columns(joined, "text binary, n_lines bigint, n_dropped bigint", ("text", gone), lambda: rebuild).withColumn("text", F.col("text").cast("string"))
    return made.select(*(col(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
