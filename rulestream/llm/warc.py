"""Content-addressed web archive.

An archive is two tables under one folder: ``payloads`` holds each distinct payload once, under
its SHA-256, and ``headers`` holds the exact header bytes of every record with the address of its
payload. Writing checks that one address never stands for two lengths or two SHA-1 digests; reading
digests the stored payloads again and joins them to the headers. Original records (header, empty
line, payload, two line ends) come back byte for byte through that join, and ``describe`` takes them
apart again and checks lengths and digests.

Records with equal payloads of at least ``min_revisit_bytes`` bytes are one response, the record
with the largest id, and revisits that refer to it; smaller ones are all responses. Equal means
equal SHA-256 and length. A revisit's block is empty.

Most payloads are there once and go from the input to the store without a shuffle; copies are
brought together after each task has kept one of its own. The addresses that have copies are
broadcast up to ``broadcast_copies``; beyond that all payloads are grouped by address.

Defined results: a null payload is empty. White space and control characters of a url are
percent-encoded; a null or empty url is written as about:blank. Rows with a null id are responses on
their own account: they neither refer nor are referred to; an empty id is a null one. Repeated ids:
each row has its record, under a record id of its own; among equal payloads the copies of the
largest id are all responses. An empty table gives an empty archive. Other input columns are not
archived.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulestream.llm.common import col, cut, ensure_checkpoint_dir, remove, type_of

CRLF = "\r\n"
BROADCAST_COPIES = 500_000


class DigestMismatch(ValueError):
    """One address stands for different payloads, or a stored payload isn't what its address says."""


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables lie."""

    folder: str

    @property
    def payloads(self) -> str:
        return f"{self.folder}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.folder}/headers"

    def delete(self, spark: SparkSession) -> None:
        remove(spark, self.folder)


def new_archive(spark: SparkSession) -> Archive:
    """An unused place in the shared folder."""
    return Archive(f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}")


def _record_id(id_: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(F.url_encode(id_.cast("string")), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _uri(url: Column) -> Column:
    """A url that is one word: white space and control characters percent-encoded."""
    plain = url
    for code in (*range(0x21), 0x7F):
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.length(url) > 0, F.when(url.rlike(r"[\x00-\x20\x7F]"), plain).otherwise(url)).otherwise("about:blank")


def _header(date: str) -> Column:
    """The header of a row of (id, row, url, kind, newest, newest_row, sha1, sha256, length)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    is_revisit = F.col("kind") == "revisit"
    digest = F.when(is_revisit, F.sha2(F.lit(b""), 256)).otherwise(F.col("sha256"))
    refers = F.concat(line("WARC-Refers-To", _record_id(F.col("newest"), F.col("newest_row"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", _record_id(F.col("id"), F.col("row"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(is_revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("length").cast("string"))),
    ).cast("binary")


def write_archive(
    pages: DataFrame, archive: Archive, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000, date: datetime | None = None, broadcast_copies: int = BROADCAST_COPIES
) -> Archive:
    """Write a record for each row of ``pages``, as captured at ``date`` (now, if not given).

    The table of ids and addresses is written first: it settles the records' ids, and decides on
    copies, responses and revisits.
    """
    body = F.coalesce(col(payload_col).cast("binary"), F.lit(b""))
    id_ = F.when(col(id_col).cast("string") != "", col(id_col))
    rows = pages.select(id_.alias("id"), col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "length": F.octet_length("payload").cast("bigint")})
    meta = cut(rows.select("id", "url", "sha256", "length", F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("row")))
    stored = meta.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("l"), F.max("length").alias("_l"), F.min("sha1").alias("s"), F.max("sha1").alias("_s")).where("n > 1")
    stored = cut(stored.withColumn("clash", (F.col("l") != F.col("_l")) | (F.col("s") != F.col("_s"))).select("sha256", "clash"))
    if (bad := stored.where("clash").first()) is not None:
        raise DigestMismatch(f"two payloads under {bad['sha256']}")
    one_each = lambda df: df.groupBy("sha256").agg(F.first("length").alias("length"), F.first("payload").alias("payload"))
    payloads = rows.select("sha256", "length", "payload")
    if stored.count() <= broadcast_copies:
        copied = F.broadcast(stored.select("sha256"))
        payloads = payloads.join(copied, "sha256", "left_anti").unionByName(one_each(payloads.join(copied, "sha256", "left_semi")))
    else:
        payloads = one_each(payloads)
    payloads.write.option("compression", "zstd").parquet(archive.payloads)
    newest = meta.where((F.col("length") >= min_revisit_bytes) & F.col("id").isNotNull()).groupBy(F.col("sha256").alias("_a"), F.col("length").alias("_b")).agg(F.max(F.struct("id", "row")).alias("_n"))
    meta = meta.join(newest, (meta["sha256"] == newest["_a"]) & (meta["length"] == newest["_b"]), "left")
    meta = meta.withColumns({"newest": F.col("_n.id"), "newest_row": F.col("_n.row")})
    revisits = F.col("newest").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("newest"))
    meta = meta.withColumn("kind", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")))
    when = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    meta.select(_header(when).alias("header"), "sha256").write.option("compression", "zstd").parquet(archive.headers)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(header, sha256, payload, payload_bytes, payload_digest) of every record.

    Each stored payload is digested anew, once, and must be what its address says; the digests in
    the result are those of the stored bytes. Columns that aren't asked for aren't shuffled.
    """
    stored = spark.read.parquet(archive.payloads)
    found = F.sha2("payload", 256)
    right = (found == F.col("sha256")) & (F.octet_length("payload") == F.col("length"))
    stored = stored.select(
        F.when(right, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("the stored payload isn't "), F.col("sha256")))).alias("_address"),
        "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    headers = spark.read.parquet(archive.headers)
    return headers.join(stored, headers["sha256"] == stored["_address"], "inner").drop("_address")


def field(head: Column, name: str) -> Column:
    """A field of a header, given as text; null where it has none."""
    return F.nullif(F.regexp_extract(head, rf"\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _block() -> Column:
    kind = field(F.col("header").cast("string"), "WARC-Type")
    return F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))


def records(read: DataFrame) -> DataFrame:
    """``read`` with ``record``, the bytes of the whole record: a revisit's block is empty."""
    return read.withColumn("record", F.concat("header", F.lit(CRLF.encode()), _block(), F.lit((CRLF * 2).encode())))


def describe(found: DataFrame, id_type: str) -> DataFrame:
    """What the records (as ``records`` gives them) say of themselves, beside length and digest of the stored payload.

    Each record is taken apart, and must have the block that its header tells of.
    """
    text = F.col("record").cast("string")
    head = F.concat(F.substring_index(text, CRLF * 2, 1), F.lit(CRLF))
    step = found.select("record", "payload_bytes", "payload_digest", head.alias("head"))
    length, at = field(F.col("head"), "Content-Length").cast("int"), F.octet_length("head") + 2
    block = F.substring("record", at + 1, length)
    whole = (F.octet_length("record") == at + length + 4) & (F.concat(F.lit("sha256:"), F.sha2(block, 256)) == field(F.col("head"), "WARC-Block-Digest"))
    whole = whole & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == field(F.col("head"), "WARC-Payload-Digest"))
    step = step.select("head", "payload_bytes", F.when(whole, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a record isn't what its header says: "), F.col("head")))).alias("payload_digest"))
    number = lambda name: F.nullif(F.url_decode(F.regexp_extract(field(F.col("head"), name), "^<urn:record:([^:]*):[0-9]+>$", 1)), F.lit("")).cast(id_type)
    return step.select(number("WARC-Record-ID").alias("id"), "payload_bytes", "payload_digest", field(F.col("head"), "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"))


def export_warc(read: DataFrame, folder: str) -> None:
    """Gzipped WARC files of the archive's records, one file for each task."""
    # a record's last byte is a newline, which the writer puts after each row
    texts = read.select(F.concat("header", F.lit(CRLF.encode()), _block(), F.lit(b"\r\n\r")).cast("string").alias("value"))
    texts.write.option("lineSep", "\n").option("compression", "gzip").text(folder)


def round_trip(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write an archive of ``pages`` in the shared folder, put its records together again, and describe them."""
    spark = pages.sparkSession
    archive = write_archive(pages, new_archive(spark), id_col=id_col)
    return describe(records(read_archive(spark, archive)), type_of(pages, id_col))
