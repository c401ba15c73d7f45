"""The corpus pipeline: documents pass five stages, each written as Parquet and read by the next.

Toxic documents go; lines that many documents share are dropped; one document of each group of
near-duplicates stays; documents that contain benchmark items go; the rest is encoded to token ids.
The first four stages return the columns of ``documents``; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulestream.llm.bpe import encode, public_vocabulary
from rulestream.llm.common import ensure_checkpoint_dir, remove, table
from rulestream.llm.decontaminate import clean
from rulestream.llm.linededup import dedup_lines
from rulestream.llm.neardup import keep_first
from rulestream.llm.toxicity import score_documents, train

#: The stages aren't expressible in SQL: see the tests for brute-force versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two class models don't find toxic."""
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    columns = docs.columns
    return score_documents(docs, model).where("predicted = 0").select(columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least ten of them share."""
    columns = docs.columns
    fewer = dedup_lines(docs, min_docs=10, min_chars=1)
    changed = F.coalesce("n_dropped", F.lit(0)) > 0
    return fewer.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, under whatever values."""
    return clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the token ids and of the bytes decoded from them."""
    coded = encode(docs.select("doc_id", "text"), public_vocabulary(), decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each leaves lies in the shared folder until the next one is done."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        before, path = path, f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
    return docs
