"""The registered queries over the derived corpus and facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulestream.catalogs import dims
from rulestream.catalogs.checks import CHECKS
from rulestream.functions import text as txt
from rulestream.operators import context, dependencies, enrich, findings as fnd, parse, rules, secrets, taint, triage
from rulestream.plans import analytics, reports
from rulestream.sources import corpus, facts, files as src, sinks
from rulestream.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
OWNER, AS_OF = 1, facts.AS_OF


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _add(name: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = f


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return facts.findings(spark, d), facts.scans(spark, d)


# sources, sinks

PATHS = ("src/a.py", "node_modules/x/b.js", "web/.cache/c.js", "lib/min.min.js", "docs/readme.md", "img/Logo.PNG", "go.sum", "deep/build/d.java", "a/b/c/e.TS", "Dockerfile", "conf/x.dockerfile", "f.kts", "noext", ".hidden")


@query
def s1_directory_scan(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    named = part.select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % len(PATHS) + 1).cast("int"))).alias("path"), (F.col("p_partkey") * 40_000 % 9_000_000).alias("size"))
    return named.where(src.discovered(F.col("path"), F.col("size"))).select("p_partkey", "path", "size")


@query
def s2_text_decode(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return docs.select("doc_id", F.md5(F.encode(src.decoded(F.col("content")), "UTF-8")).alias("digest"))


@query
def s6_stored_findings(spark: SparkSession, d: str) -> DataFrame:
    f, _ = _facts(spark, d)
    rows = f.withColumns({"title": F.repeat("title", 60), "snippet": F.repeat("rule_id", 400)})
    return sinks.stored(rows, "src").groupBy("category", "severity", "status").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("title")).alias("longest_title"), F.max(F.length("snippet")).alias("longest_snippet"), F.min("file_path").alias("first_path"))


@query
def s7_relative_path(spark: SparkSession, d: str) -> DataFrame:
    f, _ = _facts(spark, d)
    return f.select(txt.relative_path(F.col("file_path"), F.lit("src/pkg1/")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# structure


@query
def p1_detect_language(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % len(PATHS) + 1).cast("int"))
    return part.select("p_partkey", parse.detect_language(path).alias("language"))


@query
def p2_language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return parse.language_histogram(corpus.files(spark, d))


@query
def p3_lines_scanned(spark: SparkSession, d: str) -> DataFrame:
    return parse.lines_scanned(corpus.files(spark, d))


@query
def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    return parse.lines_of(corpus.files(spark, d)).select("path", F.col("line_no").cast("bigint").alias("line_no"), "text")


@query
def p4_structure(spark: SparkSession, d: str) -> DataFrame:
    return parse.nodes(corpus.files(spark, d)).where("kind <> 'string'").select("path", "kind", "name", "text", F.col("line_no").cast("bigint").alias("line_no"))


@query
def p4_strings(spark: SparkSession, d: str) -> DataFrame:
    return parse.nodes(corpus.files(spark, d)).where("kind = 'string'").groupBy("path", "line_no").agg(F.count(F.lit(1)).alias("n")).select("path", F.col("line_no").cast("bigint").alias("line_no"), "n")


@query
def p6_snippets(spark: SparkSession, d: str) -> DataFrame:
    lines = F.col("_lines")
    rows = corpus.files(spark, d).withColumn("_lines", txt.split_lines(F.col("content"))).select("path", "_lines", F.explode(F.sequence(F.lit(1), F.size("_lines"))).alias("line_no"))
    return rows.select("path", F.col("line_no").cast("bigint").alias("line_no"), txt.snippet(lines, F.col("line_no"), F.col("line_no") + 1).alias("snippet"))


@query
def p7_frameworks(spark: SparkSession, d: str) -> DataFrame:
    return parse.frameworks(corpus.files(spark, d))


@query
def p8_rules_by_language(spark: SparkSession, d: str) -> DataFrame:
    rows = [(language, r.id, r.category) for language, _ in corpus.LANGUAGES for r in rules.rules_for(language)]
    return spark.createDataFrame(rows, "language string, rule_id string, category string")


# rules, taint, checks, secrets


@query
def r2_rule_matches(spark: SparkSession, d: str) -> DataFrame:
    hits = rules.rule_matches(corpus.files(spark, d))
    return hits.select("path", F.col("rule_ord").cast("bigint").alias("rule_ord"), F.col("match_ord").cast("bigint").alias("match_ord"), *(F.col(c).cast("bigint").alias(c) for c in ("line_start", "line_end", "col_start")), "matched")


@query
def r8_rule_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_findings(corpus.files(spark, d)).groupBy("rule_id", "category", "severity", "cwe_id", "owasp", "confidence", "method").agg(F.count(F.lit(1)).alias("n"))


@query
def t4_source_lines(spark: SparkSession, d: str) -> DataFrame:
    hits = taint.source_hits(corpus.files(spark, d))
    return hits.select("path", F.col("line_no").cast("bigint").alias("line_no"), "pattern", "variable")


def _flows(spark: SparkSession, d: str, kind: str, users: int = 1) -> DataFrame:
    hits = taint.flows(corpus.files(spark, d, users)).where(F.col("kind") == kind)
    return hits.select("path", F.col("source_line").cast("bigint").alias("source_line"), "source_word", F.col("sink_line").cast("bigint").alias("sink_line"), "flaw", "sink_word", "confidence")


@query
def t6_traced_flows(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d, "traced")


@query
def t6_traced_flows_long_files(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d, "traced", 10)


@query
def t7_direct_flows(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d, "direct")


@query
def t9_taint_findings(spark: SparkSession, d: str) -> DataFrame:
    return fnd.dedup(taint.taint_findings(corpus.files(spark, d))).select("rule_id", "category", "severity", "cwe_id", "owasp", "confidence", "file_path", F.col("line_start").cast("bigint").alias("line_start"), F.col("line_end").cast("bigint").alias("line_end"), "source", "sink", "fingerprint")


def _check(number: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = context.context_hits(corpus.files(spark, d), (CHECKS[number],))
        return hits.select("path", F.lit(CHECKS[number].id).alias("rule_id"), F.col("line").cast("bigint").alias("line_start"), F.col("end").cast("bigint").alias("line_end"), F.col("pat").cast("bigint").alias("pattern"))

    return run


for _i, _c in enumerate(CHECKS):
    _add(f"b{_i + 1}_{_c.id[3:].lower()}", _check(_i))


@query
def b15_context_findings(spark: SparkSession, d: str) -> DataFrame:
    return context.context_findings(corpus.files(spark, d)).groupBy("rule_id", "category", "severity", "cwe_id", "owasp", "confidence", "method").agg(F.count(F.lit(1)).alias("n"))


@query
def k1_secrets(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.lit(None).cast("string").alias("language"), F.col("text").alias("content"))
    return secrets.secret_findings(docs).select("file_path", "rule_id", "severity", F.col("line_start").cast("bigint").alias("line_start"), F.col("ord_b").alias("k"))


@query
def k2_entropy(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_partkey", F.round(txt.entropy(F.col("p_name")), 6).alias("bits"))


# dependencies


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of all parsed kinds made of the derived packages."""
    p = facts.packages(spark, d).withColumn("m", F.element_at(F.array(*map(F.lit, MANIFEST_NAMES)), (F.col("pkg_ord") % len(MANIFEST_NAMES) + 1).cast("int"))).withColumn("dir", F.concat(F.lit("m"), F.col("pkg_ord") % 40))
    line = (
        F.when(F.col("m") == "requirements.txt", F.concat("name", F.lit("[x]>="), "version")).when(F.col("m") == "go.mod", F.concat(F.lit("\t"), "name", F.lit(" v"), "version"))
        .when(F.col("m") == "Gemfile", F.concat(F.lit("gem '"), "name", F.lit("', '"), "version", F.lit("'"))).when(F.col("m") == "Cargo.toml", F.concat(F.replace("name", F.lit("-"), F.lit("_")), F.lit(' = "'), "version", F.lit('"')))
        .otherwise(F.concat(F.lit('"p'), F.col("pkg_ord"), F.lit("-"), "name", F.lit('": "^'), "version", F.lit('"')))
    )
    made = p.groupBy("dir", "m").agg(F.array_sort(F.collect_list(F.struct("pkg_ord", line.alias("t")))).alias("l"))
    texts = F.transform("l", lambda x: x["t"])
    section = F.when(F.col("m") == "package.json", "dependencies").otherwise("require")
    json = F.concat(F.lit('{"'), section, F.lit('": {'), F.array_join(texts, ", "), F.lit("}}"))
    return made.select(F.concat("dir", F.lit("/"), "m").alias("path"), F.lit(None).cast("string").alias("language"), F.when(F.col("m").endswith(".json"), json).otherwise(F.array_join(texts, "\n")).alias("content"))


MANIFEST_NAMES = ("requirements.txt", "package.json", "go.mod", "Gemfile", "composer.json", "Cargo.toml", "pom.xml")


@query
def d1_manifests(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.manifests(_manifests(spark, d)).groupBy("filename", "ecosystem").agg(F.count(F.lit(1)).alias("n"))


@query
def d2_d7_packages(spark: SparkSession, d: str) -> DataFrame:
    found = dependencies.packages(dependencies.manifests(_manifests(spark, d)))
    return found.select("path", "ecosystem", "name", "version", F.col("line").cast("bigint").alias("line"))


@query
def d8_advisories(spark: SparkSession, d: str) -> DataFrame:
    manifest = F.concat(F.lit("src/n"), F.floor(F.col("pkg_ord") / 70))  # 70 packages each: the limit binds, and manifests grow with the table
    pkgs = facts.packages(spark, d).withColumn("path", manifest).withColumn("pkg_ord", F.col("pkg_ord") % 70)
    return dependencies.advisory_matches(pkgs, facts.advisories(spark, d)).select("path", "pkg_ord", "ecosystem", "name", "version", "advisory_id", "severity", "fixed")


@query
def d9_look_alikes(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.look_alikes(facts.packages(spark, d)).select("path", "ecosystem", "name", F.col("pkg_ord"), "popular", "distance")


@query
def d10_internal_names(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.internal_names(facts.packages(spark, d)).select("path", "ecosystem", "name", "pkg_ord")


@query
def d11_dependency_findings(spark: SparkSession, d: str) -> DataFrame:
    found = fnd.dedup(fnd.union([dependencies.dependency_findings(_manifests(spark, d))]))
    return found.select("file_path", "rule_id", "severity", F.col("line_start").cast("bigint").alias("line_start"), "fingerprint")


# union, dedup, scores


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return fnd.scan(corpus.files(spark, d))


@query
def u3_scan_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).select("rule_id", "file_path", F.col("line_start").cast("bigint").alias("line_start"), "severity", "fingerprint")


@query
def u5_risk_by_file(spark: SparkSession, d: str) -> DataFrame:
    return fnd.severity_counts(_scan(spark, d), ["file_path"])


@query
def u6_ranked(spark: SparkSession, d: str) -> DataFrame:
    order = fnd.severity_score(F.col("severity"))
    return fnd.ranked(_scan(spark, d)).select("rule_id", "file_path", F.col("line_start").cast("bigint").alias("line_start"), order.cast("bigint").alias("score"))


@query
def u7_profile_quick(spark: SparkSession, d: str) -> DataFrame:
    both = corpus.files(spark, d).unionByName(_manifests(spark, d))
    return fnd.scan(both, "quick").groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def u7_profile_deep(spark: SparkSession, d: str) -> DataFrame:
    return fnd.scan(corpus.files(spark, d), "deep").groupBy("ai_analyzed", "exploitability").agg(F.count(F.lit(1)).alias("n"))


@query
def u7_profile_bug_bounty(spark: SparkSession, d: str) -> DataFrame:
    return fnd.scan(corpus.files(spark, d), "bug_bounty").groupBy("ai_analyzed", "exploitability").agg(F.count(F.lit(1)).alias("n"))


@query
def u8_single_text(spark: SparkSession, d: str) -> DataFrame:
    return fnd.scan(corpus.files(spark, d), "quick", single=True).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# enrichment, triage


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    f, _ = _facts(spark, d)
    return f.withColumns({"seq": F.col("finding_id"), "snippet": F.lit(""), "source": F.lit(None).cast("string"), "sink": F.lit(None).cast("string"), "confidence": F.lit(0.8)})


@query
def a1_eligible(spark: SparkSession, d: str) -> DataFrame:
    return enrich.eligible(_numbered(spark, d), "deep").select("finding_id", "asked")


@query
def a4_enriched_offline(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.enrich(_numbered(spark, d).drop("cvss_score"), "bug_bounty")
    return rows.groupBy("severity", "ai_analyzed", "confidence", "exploitability", "cvss_score").agg(F.count(F.lit(1)).alias("n"))


def _verdict(prompt: str) -> str:
    """A provider for tests: finds every title that ends in 3 invalid, and says little of the others."""
    import json

    title = json.loads(prompt)["title"]
    return f'Here: ```json\n{{"is_valid": {"false" if title.endswith("3") else "true"}, "confidence": 0.9, "exploitability": "HIGH"}}\n```'


@query
def a5_enriched_by_provider(spark: SparkSession, d: str) -> DataFrame:
    rows = enrich.enrich(_numbered(spark, d).drop("cvss_score"), "deep", _verdict)
    return rows.groupBy("severity", "ai_analyzed", "confidence", "exploitability").agg(F.count(F.lit(1)).alias("n"))


@query
def q13_triage(spark: SparkSession, d: str) -> DataFrame:
    f, _ = _facts(spark, d)
    return triage.apply_triage(f, facts.derive(spark, d, facts.TRIAGE)).select("finding_id", "status", "is_false_positive", "reason")


@query
def q14_cancel(spark: SparkSession, d: str) -> DataFrame:
    return triage.cancel(facts.scans(spark, d), facts.derive(spark, d, facts.CANCELS)).select("scan_id", "created_by_id", "status")


# dashboards


def _q(name: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    _add(name, lambda spark, d: f(*_facts(spark, d)))


_q("q1_total_scans", lambda f, s: analytics.scan_totals(s, OWNER, AS_OF).select("total_scans"))
_q("q2_active_scans", lambda f, s: analytics.scan_totals(s, OWNER, AS_OF).select("active_scans"))
_q("q3_severity_distribution", lambda f, s: analytics.severity_distribution(f, s, OWNER))
_q("q4_mean_risk", lambda f, s: analytics.scan_totals(s, OWNER, AS_OF).select("risk_score"))
_q("q5_owasp_rollup", lambda f, s: analytics.owasp_rollup(f, s, OWNER))
_q("q6_recent_scans", lambda f, s: analytics.scan_totals(s, OWNER, AS_OF).select("recent_scans_7d"))
_q("q7_trends", lambda f, s: analytics.trends(f, s, OWNER, AS_OF).withColumn("date", F.col("date").cast("string")))
_q("q8_top_findings", lambda f, s: analytics.top_findings(f, s, OWNER).select("finding_id", "title", "severity", "cvss_score", "scan_name"))
_q("q8_top_findings_by_risk", lambda f, s: analytics.top_findings(f, s, OWNER, severity_order="risk_desc").select("finding_id", "title", "severity", "cvss_score", "scan_name"))
_q("q9_cwe_breakdown", lambda f, s: analytics.cwe_breakdown(f, s, OWNER))
_q("q10_list_scans", lambda f, s: analytics.list_scans(s, OWNER, status="completed", offset=5).select("scan_id", "name", "status", "risk_score"))
_q("q11_list_findings", lambda f, s: analytics.list_findings(f, 7, severity="high").select("finding_id", "severity", "category", "status"))
_q("q12_lookup", lambda f, s: analytics.lookup(s, "scan_id", 7).select("scan_id", "name", "status"))
_add("q15_taken", lambda spark, d: analytics.taken(facts.derive(spark, d, facts.USERS), "user3@example.org", "user5"))
_add("q16_at_least", lambda spark, d: analytics.at_least(facts.derive(spark, d, facts.USERS), "bug_bounty_hunter").select("user_id", "role"))
_q("dashboard_summary", lambda f, s: analytics.summary(f, s, OWNER, AS_OF))

# client analytics and reports

_q("f1_pie", lambda f, s: reports.pie(analytics.severity_distribution(f, s, OWNER)))
_q("f2_merged_low", lambda f, s: reports.merged_low(analytics.trends(f, s, OWNER, AS_OF)).withColumn("date", F.col("date").cast("string")))
_q("f2_risk_bands", lambda f, s: s.groupBy(reports.risk_band(F.col("risk_score")).alias("band")).agg(F.count(F.lit(1)).alias("n")))
_q("f3_labelled", lambda f, s: reports.labelled(f).groupBy("file_name", "cvss_band").agg(F.count(F.lit(1)).alias("n")))
_q("f4_potential_bounty", lambda f, s: reports.potential_bounty(analytics.top_findings(f, s, OWNER, 20, "risk_desc")))
_q("f5_radar", lambda f, s: reports.radar(analytics.severity_distribution(f, s, OWNER)))
_q("f6_bounty_range", lambda f, s: reports.bounty_range(f).groupBy("severity", "bounty_range").agg(F.count(F.lit(1)).alias("n")))
_q("f7_client_filter", lambda f, s: reports.matching(f, ["HIGH"], "xss").select("finding_id", "severity", "category"))
_q("f8_completed_among_newest", lambda f, s: reports.completed_among_newest(s).select("scan_id", "status"))
_q("f13_severity_select", lambda f, s: reports.matching(f, []).groupBy("severity").agg(F.count(F.lit(1)).alias("n")))


def _per_scan(f: DataFrame) -> DataFrame:
    return f.withColumn("seq", (F.col("finding_id") % 1000).cast("int"))


_q("f9_submission_report", lambda f, s: reports.submission_report(_per_scan(f)))
_q("f10_executive_report", lambda f, s: reports.executive_report(fnd.severity_counts(f, ["scan_id"])))
_q("f11_sarif_results", lambda f, s: reports.sarif_results(_per_scan(f)))
_q("f11_sarif", lambda f, s: reports.sarif(_per_scan(f)).select("scan_id", F.get_json_object("sarif", "$.version").alias("version"), F.get_json_object("sarif", "$.runs[0].results[0].ruleId").alias("first_rule"), F.get_json_object("sarif", "$.runs[0].results[0].locations[0].physicalLocation.region.startLine").alias("first_line")))
_q("f12_developer_guide", lambda f, s: reports.developer_guide(_per_scan(f)))

# streaming


@query
def stream_progress_latest(spark: SparkSession, d: str) -> DataFrame:
    return progress.latest(facts.derive(spark, d, facts.PROGRESS)).select("scan_id", "status", "phase", "progress", "findings", "done")


@query
def stream_phases(spark: SparkSession, d: str) -> DataFrame:
    events = facts.derive(spark, d, facts.PROGRESS)
    return events.groupBy(progress.phase_of(F.col("progress")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = facts.derive(spark, d, facts.PROGRESS)
    return progress.sessions(events, "12 hours").select("scan_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query
def flagship_risk(spark: SparkSession, d: str) -> DataFrame:
    """Lines to risk: the pattern rules over every file, deduplicated, counted by severity and scored."""
    return fnd.severity_counts(fnd.dedup(fnd.union([rules.rule_findings(corpus.files(spark, d))])), ["file_path"])
