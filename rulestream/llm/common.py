"""What the operators of this subpackage share: tables, lineage cuts, Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII white space: space and U+0009 to U+000D. Words are runs of anything else.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_BYTES = WS_CHARS.encode()
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set and Spark runs on this machine alone."""
    sc = spark.sparkContext
    if found := sc.getCheckpointDir():
        return found
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rulestream-ckpt-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that one of these operators has written and nothing needs any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def col(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has columns of those names, so that none of its columns is hidden."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that new ones of these names replace."""
    replaced = {n.lower() for n in names}
    return df.select(*(col(c) for c in df.columns if c.lower() not in replaced))


def valid(text: str = "text") -> Column:
    """A text with U+FFFD for each sequence of bytes that isn't UTF-8."""
    return F.make_valid_utf8(col(text))


def text_hash(text: str = "text") -> Column:
    """With the doc_id it names a row's content, also where doc_ids repeat."""
    return F.xxhash64(col(text))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def add_columns(df: DataFrame, fields: str, sources: str | Column | tuple[str | Column, ...], fill: Callable[[], Callable[..., list[list]]], rows: int = 256) -> DataFrame:
    """``df`` with columns made by Python from some of its columns; the new ones come last.

    ``fill()`` is called once for each task and gives a function from the values of the source
    columns (texts as UTF-8 bytes) to those of the new columns. It is called for ``rows`` rows at a
    time and its results leave at once, so a worker holds no more than one Arrow batch of input and
    one slice of output. New columns replace those of the same name, which may be sources.
    """
    sources = sources if isinstance(sources, tuple) else (sources,)
    made = T._parse_datatype_string(fields)
    names = [f.name for f in made]
    rest = without(df, *names)
    kept = rest.columns
    schema = T.StructType([*rest.schema.fields, *made])
    # inside, columns go by number: their own names may be anything
    values = [*(col(c) for c in kept), *(col(c) if isinstance(c, str) else c for c in sources)]
    df = df.select(*(c.alias(f"c{i}") for i, c in enumerate(values)))
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fill()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                given = [_as_bytes(c).to_pylist() for c in part.columns[len(kept) :]]
                new = [pa.array(v, k) for v, k in zip(work(*given), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], names=[*kept, *names])

    return df.mapInArrow(run, schema)


def _as_bytes(column: pa.Array) -> pa.Array:
    if pa.types.is_string(column.type):
        return column.cast(pa.binary())
    return column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, per_class: int) -> DataFrame:
    """(doc_id, label, weight, text) of at most about ``per_class`` labelled ids of each class, for training.

    Rows held out (crc32 of the id modulo ``parts`` is ``part``) and rows without a label, id or
    text are left out; of contradicting labels for an id, the largest counts, and of several texts
    the first by hash. The ids are chosen by hash, so the sample doesn't depend on the order of the
    rows, and the chosen ids are broadcast: ``per_class`` bounds them and the sample. ``weight`` is
    the number of labelled ids of the class for each chosen one. Documents are read once, and no
    others than those chosen are shuffled.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.where(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for k, count in n.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, per_class / count))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    weight = F.lit(1.0)
    if any(count > per_class for count in n.values()):
        for r in chosen.groupBy("label").count().collect():
            weight = F.when(F.col("label") == r["label"], F.lit(n[r["label"]] / r["count"])).otherwise(weight)
    chosen = chosen.withColumn("weight", weight)
    texts = docs.select("doc_id", valid().alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label", "weight").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
