"""Scans, findings, packages and logs derived from the order tables, for tests and benchmarks.

The same SQL text makes them in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulestream.catalogs import dims

AS_OF = "1998-06-30 00:00:00"


def _case(key: str, items) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


SCANS = f"""
SELECT o_orderkey AS scan_id, o_custkey % 5 AS created_by_id, concat('scan-', o_orderkey) AS name,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
       {_case("o_orderkey % 4", ("quick", "standard", "deep", "bug_bounty"))} AS scan_profile,
       CAST(o_orderkey % 101 AS INT) AS risk_score, o_orderdate AS created_at
FROM {{orders}}"""

FINDINGS = f"""
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS finding_id,
       l_orderkey AS scan_id, concat('RULE_', l_partkey % 90) AS rule_id, concat('Finding ', l_partkey % 90) AS title,
       {_case("l_suppkey % 21", (c for c, _ in dims.CATEGORIES))} AS category,
       {_case("(l_partkey + l_linenumber) % 5", dims.SEVERITY_NAMES)} AS severity,
       CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'confirmed' END AS status,
       concat('src/pkg', l_suppkey % 13, '/file', l_partkey % 37, '.py') AS file_path,
       CAST(l_linenumber * 10 + l_partkey % 10 AS INT) AS line_start,
       CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE concat('CWE-', l_partkey % 40) END AS cwe_id, CAST(NULL AS VARCHAR(20)) AS cwe_name,
       CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity / 5 END AS cvss_score,
       l_returnflag = 'R' AS is_false_positive, 'sast_rule' AS detection_method,
       concat('A0', l_suppkey % 9, ':2021') AS owasp_category, l_shipdate AS created_at
FROM {{lineitem}}"""

PACKAGES = f"""
SELECT concat('src/m', p_partkey % 50) AS path, {_case("p_partkey % 7", ("PyPI", "npm", "Go", "RubyGems", "Packagist", "crates.io", "PyPI"))} AS ecosystem,
       CASE p_partkey % 4 WHEN 0 THEN substr(base, 2) WHEN 1 THEN concat(base, substr(base, length(base), 1))
            WHEN 2 THEN concat(substr(base, 2, 1), substr(base, 1, 1), substr(base, 3)) ELSE concat('internal-', base) END AS name,
       concat(p_size, '.0') AS version, CAST(p_partkey % 30 AS INT) AS line, CAST(p_partkey AS INT) AS pkg_ord
FROM (SELECT *, {_case("p_partkey % 17", dims.POPULAR["PyPI"])} AS base FROM {{part}}) x"""

ADVISORIES = """
SELECT DISTINCT ecosystem, name, version, concat('ADV-', k, '-', length(name)) AS advisory_id,
       CASE k WHEN 0 THEN 'MODERATE' WHEN 1 THEN 'high' WHEN 2 THEN 'LOW' ELSE NULL END AS label,
       concat(version, '.', k) AS fixed, CASE WHEN k = 3 THEN 9.8 WHEN k = 1 THEN 0.0 ELSE NULL END AS score, CAST(k AS INT) AS vuln_ord
FROM (SELECT * FROM {packages} WHERE pkg_ord % 3 = 0) p CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) a"""

TRIAGE = """
SELECT l_orderkey * 1000 + 1 AS finding_id, l_shipdate AS ts, CAST(l_partkey * 100 + l_suppkey AS BIGINT) AS seq,
       CASE l_linenumber % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'accepted_risk' WHEN 2 THEN 'bogus' ELSE NULL END AS status,
       CASE l_linenumber % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS is_false_positive,
       CASE WHEN l_linenumber % 3 = 0 THEN concat('note ', l_partkey) ELSE NULL END AS reason
FROM {lineitem} WHERE l_quantity > 25"""

CANCELS = "SELECT o_orderkey AS scan_id, o_orderkey % 5 AS user_id FROM {orders} WHERE o_orderkey % 3 = 0"

USERS = """
SELECT c_custkey AS user_id, concat('user', c_custkey, '@example.org') AS email, concat('user', c_custkey) AS username,
       CASE c_custkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'security_engineer' WHEN 2 THEN 'bug_bounty_hunter' WHEN 3 THEN 'developer' ELSE 'viewer' END AS role
FROM {customer}"""

PROGRESS = """
SELECT user_id AS scan_id, ts, event_id AS seq, event_type AS phase, CAST(event_id % 101 AS INT) AS progress, CAST(event_id % 7 AS INT) AS findings,
       CASE WHEN event_id % 101 = 100 THEN 'completed' ELSE 'running' END AS status
FROM {events}"""


def derive(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    """A derived table; the base tables that its text names are read from ``sf_dir``."""
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "part", "customer", "events") if "{" + t + "}" in text}
    return spark.sql(text, **base, **more)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, SCANS)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, FINDINGS)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, PACKAGES)


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, ADVISORIES, packages=packages(spark, sf_dir))


def sql(*names: str) -> str:
    """The derived tables as common table expressions for DuckDB."""
    texts = {"scans": SCANS, "findings": FINDINGS, "packages": PACKAGES, "advisories": ADVISORIES, "triage": TRIAGE, "cancels": CANCELS, "users": USERS, "progress": PROGRESS}
    tables = {t: t for t in ("orders", "lineitem", "part", "customer", "events", "packages")}
    return ",\n".join(f"{n} AS ({texts[n].format(**tables)})" for n in names)
