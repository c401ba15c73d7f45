"""Files from a directory tree, a checked-out repository or a zip upload, and what is left out of them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulestream.catalogs import dims
from rulestream.functions.text import base_name, relative_path
from rulestream.operators.parse import detect_language

MOST_UPLOAD_BYTES = 50 * 1024 * 1024
MOST_UNPACKED_BYTES = 20 * MOST_UPLOAD_BYTES


def discovered(path: Column, size: Column) -> Column:
    """Whether a scan takes a file: no directory on its way is left out or starts with a dot, nor is its suffix, and it isn't too large.

    ``path`` is relative to the scanned directory.
    """
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    pruned = F.exists(dirs, lambda d: d.isin(*dims.SKIPPED_DIRS) | F.startswith(d, F.lit(".")))
    name = F.lower(base_name(path))
    return ~pruned & ~reduce(or_, (F.endswith(name, F.lit(s)) for s in dims.SKIPPED_SUFFIXES)) & (size <= dims.MOST_BYTES)


def from_bytes(rows: DataFrame, base: str = "") -> DataFrame:
    """(path, language, content) of the (path, length, content) rows that a scan takes."""
    named = rows.withColumn("path", relative_path(F.col("path"), F.lit(base))) if base else rows
    taken = named.where(discovered(F.col("path"), F.col("length")))
    return taken.select("path", detect_language(F.col("path")).alias("language"), decoded(F.col("content")).alias("content"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, with replacement characters for what isn't."""
    return F.make_valid_utf8(content.cast("string"))


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, content) of a directory tree. Large files are dropped before their content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= dims.MOST_BYTES)
    full = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/+", "/")
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/+", "/", root)
    return from_bytes(rows.select(full.alias("path"), "length", "content"), base)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """(path, language, content) of an upload of at most 50 MB: the entries of a zip archive, or the file itself, by its name."""
    if path.lower().endswith(".zip"):
        return from_bytes(read_zip(spark, path))
    rows = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_UPLOAD_BYTES)
    return from_bytes(rows.select(base_name(F.col("path")).alias("path"), "length", "content"))


def read_zip(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length, content) of the entries of zip archives; one task opens an archive of at most 50 MB."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    # what unpacks to very much more than it is, is no upload of sources
                    if sum(entry.file_size for entry in archive.infolist()) > MOST_UNPACKED_BYTES:
                        continue
                    for entry in archive.infolist():
                        if not entry.is_dir() and entry.file_size <= dims.MOST_BYTES:
                            yield pd.DataFrame([(entry.filename, entry.file_size, archive.read(entry))], columns=["path", "length", "content"])

    archives = spark.read.format("binaryFile").load(glob).where(F.col("length") <= MOST_UPLOAD_BYTES).select("content")
    return archives.mapInPandas(run, "path string, length bigint, content binary")
