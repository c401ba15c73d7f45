"""A finding as a struct, so that all engines can put theirs into one array over a file's row.

Whatever a finding needs of its file's lines, such as its snippet, is taken while the lines are at
hand: the arrays are exploded once, and no exploded row carries lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulestream.functions.text import let, split_lines

TYPES = {
    "stage_ord": "int", "rule_id": "string", "title": "string", "category": "string", "severity": "string", "line_start": "int", "line_end": "int", "col_start": "int", "snippet": "string", "cwe_id": "string", "owasp": "string",
    "confidence": "double", "method": "string", "source": "string", "sink": "string", "ord_a": "bigint", "ord_b": "bigint", "flow_ord": "string",
}


def finding(**values) -> Column:
    """A finding; fields that aren't given are null, but for the column (0) and the order of flows (empty)."""
    given = {"col_start": 0, "flow_ord": ""} | values
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*(as_column(given.get(name)).cast(kind).alias(name) for name, kind in TYPES.items()))


def explode_findings(files: DataFrame, *engines: Callable[[Column], Column]) -> DataFrame:
    """Findings of engines that each give an array of them for a file, from its lines; the input is read once."""
    found = let(split_lines(F.col("content")), lambda lines: F.concat(*(F.coalesce(e(lines), F.array().cast(f"array<struct<{', '.join(f'{n}:{t}' for n, t in TYPES.items())}>>")) for e in engines)))
    rows = files.select(F.col("path").alias("file_path"), F.explode(found).alias("f"))
    return rows.select("file_path", "f.*")
