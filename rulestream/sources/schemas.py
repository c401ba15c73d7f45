"""The tables that scans read and write, as schemas."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string


def _schema(text: str) -> StructType:
    return _parse_datatype_string(text)


# Columns and types of the tables.
FILES = "path string, language string, content string"
FINDINGS = (
    "finding_id bigint, scan_id bigint, rule_id string, title string, category string, severity string, status string, file_path string, line_start int, line_end int, column_start int, snippet string, cwe_id string, cwe_name string, "
    "owasp_category string, cvss_score double, ai_confidence double, ai_analyzed boolean, is_false_positive boolean, detection_method string, taint_source string, taint_sink string, fingerprint string, references array<string>, created_at timestamp"
)
SCANS = "scan_id bigint, created_by_id bigint, name string, status string, scan_profile string, risk_score int, total_findings int, created_at timestamp"
ADVISORIES = "ecosystem string, name string, version string, advisory_id string, label string, fixed string, score double, vuln_ord int"
TRIAGE = "finding_id bigint, ts timestamp, status string, is_false_positive boolean, reason string"
PROGRESS = "scan_id bigint, ts timestamp, seq bigint, status string, phase string, progress int, findings int"
TABLES = {"files": FILES, "findings": FINDINGS, "scans": SCANS, "advisories": ADVISORIES, "triage": TRIAGE, "progress": PROGRESS}


def table_schema(name: str) -> StructType:
    """The schema of a table by its name."""
    return _schema(TABLES[name])
