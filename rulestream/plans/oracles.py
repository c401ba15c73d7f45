"""DuckDB SQL for the registered queries: the same questions asked another way.

Where the operators work inside a file's row, these use joins and window frames over lines.
"""

from __future__ import annotations

from rulestream.catalogs import dims, taint
from rulestream.catalogs.checks import CHECKS, Check, Guard
from rulestream.catalogs.rules import RULES
from rulestream.catalogs.secrets import SECRETS
from rulestream.operators.parse import PACKS
from rulestream.operators.rules import rules_for
from rulestream.plans.queries import AS_OF, MANIFEST_NAMES, OWNER, PATHS
from rulestream.sources import facts
from rulestream.sources.corpus import LANGUAGES, lines_sql, quote, values

ORACLES: dict[str, str] = {}
LINES = "WITH " + lines_sql()
SEV = "severity_dim AS (SELECT * FROM " + values([(s[0], s[1], s[2], s[3], s[4], s[5]) for s in dims.SEVERITIES], "severity, score, ord, weight, low, high") + ")"
CAT = "category_dim AS (SELECT * FROM " + values(list(dims.CATEGORIES), "category, owasp") + ")"


def _list(items) -> str:
    return "[" + ", ".join(map(quote, items)) + "]"


def _ci(pattern: str) -> str:
    return quote("(?i)" + pattern)


# sources, structure

_NAME = "regexp_extract(path, '[^/]*$')"
_SUFFIXES = " OR ".join(f"ends_with(lower({_NAME}), {quote(s)})" for s in dims.SKIPPED_SUFFIXES)
ORACLES["s1_directory_scan"] = f"""
WITH p AS (SELECT p_partkey, {_list(PATHS)}[p_partkey % {len(PATHS)} + 1] AS path, p_partkey * 40000 % 9000000 AS size FROM part),
d AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT p_partkey, path, size FROM d
WHERE len(list_filter(parts[:-2], lambda x: x IN ({", ".join(map(quote, dims.SKIPPED_DIRS))}) OR starts_with(x, '.'))) = 0
  AND NOT ({_SUFFIXES}) AND size <= {dims.MOST_BYTES}"""
ORACLES["s2_text_decode"] = "SELECT doc_id, md5(text) AS digest FROM documents"
ORACLES["s6_stored_findings"] = f"""
WITH {facts.sql("findings")}
SELECT CASE WHEN category IN ('api', 'supply_chain') THEN 'other' ELSE category END AS category, severity, 'open' AS status, count(*) AS n,
       max(least(500, length(title) * 60)) AS longest_title, max(least(2000, length(rule_id) * 400)) AS longest_snippet, min(substr(file_path, 5)) AS first_path
FROM findings GROUP BY ALL"""
ORACLES["s7_relative_path"] = f"""
WITH {facts.sql("findings")}
SELECT CASE WHEN starts_with(file_path, 'src/pkg1/') THEN substr(file_path, 10) ELSE file_path END AS path, count(*) AS n FROM findings GROUP BY 1"""
ORACLES["p1_detect_language"] = f"""
WITH s AS (SELECT * FROM {values(list(dims.SUFFIXES.items()), "suffix, language")}),
p AS (SELECT p_partkey, {_list(PATHS)}[p_partkey % {len(PATHS)} + 1] AS path FROM part)
SELECT p_partkey, CASE WHEN {_NAME} = 'Dockerfile' THEN 'dockerfile' ELSE s.language END AS language
FROM p LEFT JOIN s ON s.suffix = lower(regexp_extract({_NAME}, '^.+(\\.[^.]*)$', 1))"""
ORACLES["p2_language_histogram"] = LINES + " SELECT language, count(*) AS n_files FROM files GROUP BY language"
ORACLES["p3_lines_scanned"] = LINES + " SELECT count(*) AS n_files, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM files"
ORACLES["p3_lines"] = LINES + " SELECT path, line_no, text FROM lines"

_PACK = f"CASE WHEN language IN ({', '.join(map(quote, PACKS))}) THEN language ELSE 'javascript' END"


def _structure() -> str:
    parts = []
    for pack, patterns in PACKS.items():
        for k, kind in enumerate(("function", "class", "import")):
            p = quote(patterns[k])
            name = "''" if kind == "import" else f"coalesce(nullif(regexp_extract(text, {p}, 1), ''), regexp_extract(text, {p}, 2))" if pack == "javascript" and k == 0 else f"regexp_extract(text, {p}, 1)"
            parts.append(f"SELECT path, '{kind}' AS kind, {name} AS name, substr(trim(text), 1, 200) AS text, line_no FROM packed WHERE pack = '{pack}' AND regexp_matches(text, {p})")
    return f"{LINES}, packed AS (SELECT *, {_PACK} AS pack FROM lines) " + " UNION ALL ".join(parts)


ORACLES["p4_structure"] = _structure()
# the snippets hold no literal that goes on over a line's end
ORACLES["p4_strings"] = f"{LINES}, packed AS (SELECT *, {_PACK} AS pack FROM lines), s AS (" + " UNION ALL ".join(f"SELECT path, line_no, len(regexp_extract_all(text, {quote(p[3])})) AS n FROM packed WHERE pack = '{k}'" for k, p in PACKS.items()) + ") SELECT path, line_no, n FROM s WHERE n > 0"
ORACLES["p6_snippets"] = f"""{LINES}
SELECT a.path, a.line_no,
       string_agg(CASE WHEN b.line_no BETWEEN a.line_no AND a.line_no + 1 THEN '>>> ' ELSE '    ' END || lpad(CAST(b.line_no AS VARCHAR), CAST(greatest(4, length(CAST(b.line_no AS VARCHAR))) AS INTEGER), ' ') || ' | ' || b.text, chr(10) ORDER BY b.line_no) AS snippet
FROM lines a JOIN lines b ON a.path = b.path AND b.line_no BETWEEN a.line_no - 2 AND a.line_no + 3 GROUP BY a.path, a.line_no"""
_SIGNALS = values([(f, s) for f, ss in dims.FRAMEWORKS.items() for s in ss], "framework, signal")
ORACLES["p7_frameworks"] = f"""
WITH nodes AS ({_structure()}), sig AS (SELECT * FROM {_SIGNALS})
SELECT DISTINCT framework FROM nodes JOIN sig ON contains(lower(nodes.text), sig.signal) WHERE kind = 'import'"""
ORACLES["p8_rules_by_language"] = f"""
WITH r AS (SELECT * FROM {values([(r.id, r.category, ",".join(r.languages)) for r in RULES], "rule_id, category, languages")}),
l AS (SELECT * FROM {values([(x,) for x, _ in LANGUAGES], "language")})
SELECT language, rule_id, category FROM l JOIN r ON languages = '' OR list_contains(string_split(languages, ','), language)"""

# rules: offsets from gaps and matches, context from a list of lines

_RULES = values([(r.ord, r.id, ",".join(r.languages), "(?im)" + r.pattern, "(?i)" + "|".join(f"(?:{n})" for n in r.negatives) if r.negatives else None, r.category, r.severity, r.cwe, r.owasp, r.confidence) for r in RULES], "rule_ord, rule_id, languages, pattern, negative, category, severity, cwe_id, owasp, confidence")
_NL = "(length({0}) - length(replace({0}, chr(10), '')))"
MATCHES = f"""{LINES},
r AS (SELECT * FROM {_RULES}),
x AS (SELECT path, content, string_split(content, chr(10)) AS l, r.*, regexp_extract_all(content, pattern) AS m, regexp_split_to_array(content, pattern) AS g
      FROM files JOIN r ON languages = '' OR list_contains(string_split(languages, ','), language)),
k AS (SELECT *, unnest(range(0, len(m))) AS k FROM x WHERE len(m) > 0),
o AS (SELECT *, m[k + 1] AS matched_all, CAST(list_sum(list_transform(g[1:k + 1], lambda t: length(t))) + coalesce(list_sum(list_transform(m[1:k], lambda t: length(t))), 0) AS BIGINT) AS off FROM k),
b AS (SELECT *, substr(content, 1, off) AS before FROM o),
h AS (SELECT path, rule_ord, rule_id, category, severity, cwe_id, owasp, confidence, negative, l, k AS match_ord, 1 + {_NL.format("before")} AS line_start, 1 + {_NL.format("before")} + {_NL.format("matched_all")} AS line_end,
             length(regexp_extract(before, '[^\\n]*$')) AS col_start, substr(matched_all, 1, 200) AS matched FROM b),
hits AS (SELECT * FROM h WHERE (negative IS NULL OR NOT regexp_matches(array_to_string(l[greatest(1, line_start - 3):line_start + 3], chr(10)), negative))
         AND NOT regexp_matches(trim(l[line_start]), '^(#|//|\\*|/\\*|<!--|''''''|\"\"\")'))"""
ORACLES["r2_rule_matches"] = MATCHES + " SELECT path, rule_ord, match_ord, line_start, line_end, col_start, matched FROM hits"
ORACLES["r8_rule_findings"] = MATCHES + " SELECT rule_id, category, severity, cwe_id, owasp, CAST(confidence AS DOUBLE) AS confidence, 'sast_rule' AS method, count(*) AS n FROM hits GROUP BY ALL"
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in dims.SEVERITY_NAMES)
_RISK = "CAST(least(100, " + " + ".join(f"{s[0].lower()} * {s[3]}" for s in dims.SEVERITIES) + ") AS INT) AS risk_score"


def _risk(by: str, rows: str) -> str:
    return f"SELECT *, {_RISK} FROM (SELECT {by}, count(*) AS total, {_COUNTS} FROM {rows} GROUP BY {by})"


ORACLES["flagship_risk"] = MATCHES + ", u AS (SELECT DISTINCT path AS file_path, rule_id, line_start, severity FROM hits) " + _risk("file_path", "u")

# taint: joins of lines with word tables

_SRC = values([(lang, i, p) for lang, ps in taint.SOURCES.items() for i, p in enumerate(ps)], "language, ord, pat")
_SINK = values([(lang, *row) for lang in taint.SINKS for row in taint.sink_rows(lang)], "language, flaw_ord, flaw, ord, pat")
_SAN = values([(lang, p) for lang, ps in taint.SANITIZERS.items() for p in ps], "language, pat")
_VAR = "CASE language " + " ".join(f"WHEN '{lang}' THEN " + (f"coalesce(nullif(regexp_extract(text, {quote(p)}, 1), ''), nullif(regexp_extract(text, {quote(p)}, 2), ''))" if lang == "javascript" else f"nullif(regexp_extract(text, {quote(p)}, 1), '')") for lang, p in taint.ASSIGNED.items()) + " END"


def _taint(users: int = 1) -> str:
    return f"""WITH {lines_sql(users)},
src AS (SELECT * FROM {_SRC}), snk AS (SELECT * FROM {_SINK}), san AS (SELECT * FROM {_SAN}),
sources AS (SELECT path, line_no, text, src.ord, src.pat, {_VAR.replace("language", "l.language").replace("text", "l.text")} AS var FROM lines l JOIN src ON src.language = l.language AND contains(l.text, src.pat)),
sinks AS (SELECT path, line_no, text, flaw_ord, flaw, snk.ord, snk.pat FROM lines l JOIN snk ON snk.language = l.language AND contains(l.text, snk.pat)
          WHERE NOT EXISTS (SELECT 1 FROM san WHERE san.language = l.language AND contains(l.text, san.pat))),
traced AS (SELECT s.path, s.line_no AS source_line, s.pat AS source_word, s.text AS source, k.line_no AS sink_line, k.text AS sink, k.flaw, k.pat AS sink_word, 0.75 AS confidence,
                  row(0, s.line_no, s.ord, k.line_no, k.flaw_ord, k.ord) AS o
           FROM sources s JOIN sinks k ON s.path = k.path AND k.line_no BETWEEN s.line_no + 1 AND s.line_no + 99 AND contains(k.text, s.var)),
direct AS (SELECT s.path, s.line_no AS source_line, s.pat AS source_word, s.text AS source, k.line_no AS sink_line, k.text AS sink, k.flaw, k.pat AS sink_word, 0.9 AS confidence,
                  row(1, s.line_no, k.flaw_ord, k.ord, s.ord, 0) AS o
           FROM sources s JOIN sinks k ON s.path = k.path AND k.line_no = s.line_no)"""


ORACLES["t4_source_lines"] = _taint() + " SELECT path, line_no, pat AS pattern, var AS variable FROM sources"
_FLOW = "path, source_line, source_word, sink_line, flaw, sink_word, CAST(confidence AS DOUBLE) AS confidence"
ORACLES["t6_traced_flows"] = _taint() + f" SELECT {_FLOW} FROM traced"
ORACLES["t6_traced_flows_long_files"] = _taint(10) + f" SELECT {_FLOW} FROM traced"
ORACLES["t7_direct_flows"] = _taint() + f" SELECT {_FLOW} FROM direct"
_FLAWS = values([(f, *x) for f, x in taint.FLAWS.items()], "flaw, category, cwe_id, owasp, severity")
ORACLES["t9_taint_findings"] = f"""{_taint()},
flaws AS (SELECT * FROM {_FLAWS}),
f AS (SELECT *, row_number() OVER (PARTITION BY path, flaw, source_line ORDER BY o) AS n FROM (SELECT * FROM traced UNION ALL SELECT * FROM direct))
SELECT 'TAINT_' || upper(flaw) AS rule_id, category, severity, cwe_id, owasp, CAST(confidence AS DOUBLE) AS confidence, path AS file_path, source_line AS line_start, sink_line AS line_end,
       trim(source) AS source, trim(sink) AS sink, md5('TAINT_' || upper(flaw) || ':' || path || ':' || source_line) AS fingerprint
FROM f JOIN flaws USING (flaw) WHERE n = 1"""

# context checks: flags over window frames


def _said(guard: Guard) -> str:
    if guard.regex:
        return f"regexp_matches(text, {_ci('|'.join(f'(?:{w})' for w in guard.words))})"
    return "(" + " OR ".join(f"contains({'lower(text)' if guard.lower else 'text'}, {quote(w)})" for w in guard.words) + ")"


def _frame(a: int, b: int) -> str:
    one = lambda n: f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING" if n > 0 else "CURRENT ROW"
    return f"OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {one(a)} AND {one(b)})"


def _paths(check: Check) -> str:
    tests = [f"NOT contains(lower(path), {quote(w)})" for w in check.path_lacks]
    if check.path_has:
        tests.append("(" + " OR ".join(f"contains(lower(path), {quote(w)})" for w in check.path_has) + ")")
    return " AND ".join(tests) or "TRUE"


def check_sql(check: Check) -> str:
    if check.whole_file:
        return f"{LINES} SELECT path, '{check.id}' AS rule_id, CAST(1 AS BIGINT) AS line_start, CAST(1 AS BIGINT) AS line_end, CAST(0 AS BIGINT) AS pattern FROM lines WHERE {_paths(check)} GROUP BY path HAVING NOT bool_or({_said(check.guards[0])})"
    if check.acts:
        parts = []
        for k, (anchor, act) in enumerate(zip(check.anchors, check.acts)):
            parts.append(f"""SELECT c.path, '{check.id}' AS rule_id, c.line_no AS line_start, m AS line_end, CAST({k} AS BIGINT) AS pattern
FROM (SELECT a.path, a.line_no, min(b.line_no) AS m FROM lines a JOIN lines b ON a.path = b.path AND b.line_no BETWEEN a.line_no + 1 AND a.line_no + 20
      WHERE regexp_matches(a.text, {_ci(anchor)}) AND regexp_matches(b.text, {_ci(act)}) GROUP BY ALL) c
WHERE NOT EXISTS (SELECT 1 FROM lines g WHERE g.path = c.path AND g.line_no BETWEEN c.line_no AND c.m AND {_said(check.guards[0]).replace("text", "g.text")})""")
        return f"{LINES} " + " UNION ALL ".join(parts)
    flags = [f"coalesce(bool_or({_said(g)}) {_frame(*g.window)}, FALSE) AS g{i}" for i, g in enumerate(check.guards)]
    held = " AND ".join([f"{'' if g.present else 'NOT '}g{i}" for i, g in enumerate(check.guards)] or ["TRUE"])
    needs = " AND ".join(["(" + " OR ".join(f"contains(lower(text), {quote(w)})" for w in ws) + ")" for ws in check.needs] or ["TRUE"])
    own = " OR ".join(f"(pack = '{lang}' AND regexp_matches(text, {_ci(p)}))" for lang, p in check.by_language.items()) or "TRUE"
    rows = " UNION ALL ".join(f"SELECT path, line_no, n, {k} AS pattern FROM flagged WHERE {f'regexp_matches(text, {_ci(a)})' if a else 'TRUE'} AND {needs} AND ({own}) AND {held}" for k, a in enumerate(check.anchors or (None,)))
    base = ", ".join(["*", f"{_PACK} AS pack", "count(*) OVER (PARTITION BY path) AS n", *flags])
    chosen = "QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) = 1" if check.first else ""
    return f"""{LINES}, flagged AS (SELECT {base} FROM lines), found AS ({rows})
SELECT path, '{check.id}' AS rule_id, line_no AS line_start, least(line_no + {check.end}, n) AS line_end, CAST(pattern AS BIGINT) AS pattern FROM found WHERE {_paths(check)} {chosen}"""


for _i, _c in enumerate(CHECKS):
    ORACLES[f"b{_i + 1}_{_c.id[3:].lower()}"] = check_sql(_c)
CONTEXT = " UNION ALL ".join(f"SELECT path, rule_id, line_start FROM ({check_sql(c)})" for c in CHECKS)
_CHECKS = values([(c.id, c.category, c.severity, c.cwe, c.owasp, c.confidence) for c in CHECKS], "rule_id, category, severity, cwe_id, owasp, confidence")
ORACLES["b15_context_findings"] = f"SELECT rule_id, category, severity, cwe_id, owasp, CAST(confidence AS DOUBLE) AS confidence, 'business_logic' AS method, count(*) AS n FROM ({CONTEXT}) JOIN (SELECT * FROM {_CHECKS}) USING (rule_id) GROUP BY ALL"

# secrets


def _secrets(table: str) -> str:
    """Secret values by line of (path, line_no, text); entropy by unnesting characters."""
    parts = [f"SELECT path, line_no, {i} AS ord, '{s[0]}' AS rule_id, '{s[1]}' AS severity, {s[2]} AS least, unnest(regexp_extract_all(text, {_ci(s[3])}, 1)) AS value, unnest(range(0, len(regexp_extract_all(text, {_ci(s[3])}, 1)))) AS k FROM {table}" for i, s in enumerate(SECRETS)]
    bits = "(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length(value) AS p FROM (SELECT unnest(string_split(value, '')) AS c) GROUP BY c))"
    return f"SELECT path, line_no, ord, rule_id, severity, k FROM ({' UNION ALL '.join(parts)}) v WHERE least = 0 OR {bits} >= least"


ORACLES["k1_secrets"] = f"""
WITH t AS (SELECT 'doc/' || doc_id AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT path AS file_path, rule_id, severity, line_no AS line_start, k AS ord_b FROM ({_secrets("t")})""".replace("k AS ord_b", "k")
ORACLES["k2_entropy"] = """
WITH c AS (SELECT p_partkey, length(p_name) AS n, unnest(string_split(p_name, '')) AS c FROM part)
SELECT p_partkey, round(-sum(p * log2(p)), 6) AS bits FROM (SELECT p_partkey, c, count(*) / any_value(n) AS p FROM c GROUP BY ALL) GROUP BY p_partkey"""

# dependencies

_M = f"""{facts.sql("packages")}, placed AS (SELECT *, {_list(MANIFEST_NAMES)}[pkg_ord % {len(MANIFEST_NAMES)} + 1] AS m, 'm' || (pkg_ord % 40) AS dir FROM packages),
manifest_eco AS (SELECT * FROM {values(list(dims.MANIFESTS.items()), "m, eco")}),
parsed AS (SELECT dir || '/' || m AS path, eco AS ecosystem,
       CASE m WHEN 'requirements.txt' THEN lower(name) WHEN 'Cargo.toml' THEN replace(name, '-', '_') WHEN 'package.json' THEN 'p' || pkg_ord || '-' || name WHEN 'composer.json' THEN 'p' || pkg_ord || '-' || name ELSE name END AS name,
       CASE m WHEN 'composer.json' THEN '^' || version ELSE version END AS version,
       CASE WHEN m LIKE '%.json' THEN 0 ELSE row_number() OVER (PARTITION BY dir, m ORDER BY pkg_ord) END AS line, pkg_ord AS o
FROM placed JOIN manifest_eco USING (m) WHERE m <> 'pom.xml')"""
ORACLES["d1_manifests"] = f"WITH {_M} SELECT m AS filename, eco AS ecosystem, count(DISTINCT dir) AS n FROM placed JOIN manifest_eco USING (m) GROUP BY ALL"
ORACLES["d2_d7_packages"] = f"WITH {_M} SELECT path, ecosystem, name, version, line FROM parsed"
_SEVERITY = "CASE WHEN coalesce(score, 0) >= 9 THEN 'CRITICAL' WHEN coalesce(score, 0) >= 7 THEN 'HIGH' WHEN coalesce(score, 0) >= 4 THEN 'MEDIUM' WHEN coalesce(score, 0) > 0 THEN 'LOW' WHEN upper(label) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(label) ELSE 'MEDIUM' END"
ORACLES["d8_advisories"] = f"""
WITH {facts.sql("packages", "advisories")},
p AS (SELECT 'src/n' || (pkg_ord // 70) AS path, ecosystem, CAST(pkg_ord % 70 AS INT) AS pkg_ord, name, version FROM packages)
SELECT path, pkg_ord, ecosystem, name, version, advisory_id, {_SEVERITY} AS severity, fixed
FROM p JOIN advisories USING (ecosystem, name, version) WHERE pkg_ord < 50
QUALIFY row_number() OVER (PARTITION BY path, pkg_ord ORDER BY vuln_ord, advisory_id) <= 3"""
_POPULAR = values([("PyPI" if e == "PyPI" else "other", n) for e, ns in dims.POPULAR.items() for n in ns], "kind, popular")
_NEAR = f"SELECT p.*, popular, levenshtein(name, popular) AS distance FROM {{0}} p JOIN (SELECT * FROM {_POPULAR}) q ON q.kind = CASE WHEN ecosystem = 'PyPI' THEN 'PyPI' ELSE 'other' END WHERE levenshtein(name, popular) BETWEEN 1 AND 2"
ORACLES["d9_look_alikes"] = f"WITH {facts.sql('packages')} SELECT path, ecosystem, name, pkg_ord, popular, distance FROM ({_NEAR.format('packages')})"
ORACLES["d10_internal_names"] = f"WITH {facts.sql('packages')} SELECT path, ecosystem, name, pkg_ord FROM packages WHERE regexp_matches(name, '(?i)^(internal|private|corp|company)[-_]|[-_](internal|private)$')"
_DEPS = f"SELECT DISTINCT path AS file_path, 'DEP_TYPOSQUATTING' AS rule_id, 'HIGH' AS severity, line AS line_start FROM ({_NEAR.format('parsed')}) UNION SELECT DISTINCT path, 'DEP_CONFUSION', 'MEDIUM', line FROM parsed WHERE regexp_matches(name, '(?i)^(internal|private|corp|company)[-_]|[-_](internal|private)$')"
ORACLES["d11_dependency_findings"] = f"WITH {_M}, f AS ({_DEPS}) SELECT file_path, rule_id, severity, line_start, md5(rule_id || ':' || file_path || ':' || line_start) AS fingerprint FROM f"

# union, dedup, scores: severities don't differ within a fingerprint, so a distinct is enough

_ALL = f"""SELECT DISTINCT rule_id, file_path, line_start, severity FROM (
SELECT rule_id, path AS file_path, line_start, severity FROM ({MATCHES} SELECT * FROM hits)
UNION ALL SELECT rule_id, file_path, line_start, severity FROM ({ORACLES["t9_taint_findings"]})
UNION ALL SELECT rule_id, path, line_start, severity FROM ({CONTEXT}) JOIN (SELECT * FROM {_CHECKS}) USING (rule_id)
UNION ALL SELECT rule_id, path, line_no, severity FROM ({LINES} {_secrets("lines")}))"""
ORACLES["u3_scan_deduplicated"] = f"SELECT rule_id, file_path, line_start, severity, md5(rule_id || ':' || file_path || ':' || line_start) AS fingerprint FROM ({_ALL})"
ORACLES["u5_risk_by_file"] = f"WITH u AS ({_ALL}) " + _risk("file_path", "u")
ORACLES["u6_ranked"] = f"WITH {SEV} SELECT rule_id, file_path, line_start, CAST(score AS BIGINT) AS score FROM ({_ALL}) JOIN severity_dim USING (severity)"
ORACLES["u7_profile_quick"] = f"""
WITH {_M}, d AS ({_DEPS}), s AS (SELECT DISTINCT rule_id, path, line_no, severity FROM ({LINES} {_secrets("lines")}))
SELECT rule_id, severity, count(*) AS n FROM (SELECT rule_id, severity FROM d UNION ALL SELECT rule_id, severity FROM s) GROUP BY ALL"""
for _profile, _severe, _budget in (("deep", "'CRITICAL', 'HIGH'", 10), ("bug_bounty", "'CRITICAL', 'HIGH', 'MEDIUM'", 20)):
    ORACLES[f"u7_profile_{_profile}"] = f"""
WITH s AS (SELECT count(*) AS n, least({_budget}, count(*) FILTER (severity IN ({_severe}))) AS asked FROM ({_ALL}))
SELECT ai_analyzed, exploitability, n FROM (SELECT TRUE AS ai_analyzed, 'MEDIUM' AS exploitability, asked AS n FROM s UNION ALL SELECT FALSE, NULL, n - asked FROM s) WHERE n > 0"""
ORACLES["u8_single_text"] = f"SELECT rule_id, count(*) AS n FROM ({_ALL}) GROUP BY rule_id"

# enrichment, triage

_ELIGIBLE = "SELECT f.*, score >= {0} AND row_number() OVER (PARTITION BY scan_id, score >= {0} ORDER BY finding_id) <= {1} AS asked FROM findings f JOIN severity_dim USING (severity)"
ORACLES["a1_eligible"] = f"WITH {facts.sql('findings')}, {SEV} SELECT finding_id, asked FROM ({_ELIGIBLE.format(75, 10)})"
ORACLES["a4_enriched_offline"] = f"""
WITH {facts.sql("findings")}, {SEV}
SELECT severity, asked AS ai_analyzed, CASE WHEN asked THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE WHEN asked THEN 'MEDIUM' END AS exploitability, CASE WHEN asked THEN 0.0::DOUBLE END AS cvss_score, count(*) AS n
FROM ({_ELIGIBLE.format(50, 20)}) GROUP BY ALL"""
ORACLES["a5_enriched_by_provider"] = f"""
WITH {facts.sql("findings")}, {SEV}
SELECT severity, asked AS ai_analyzed, CASE WHEN asked THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence, CASE WHEN asked THEN 'HIGH' END AS exploitability, count(*) AS n
FROM ({_ELIGIBLE.format(75, 10)}) WHERE NOT (asked AND title LIKE '%3') GROUP BY ALL"""
ORACLES["q13_triage"] = f"""
WITH {facts.sql("findings", "triage")},
e AS (SELECT *, CASE WHEN is_false_positive THEN 'false_positive' ELSE status END AS s FROM triage WHERE status IS NULL OR status <> 'bogus'),
l AS (SELECT finding_id, arg_max(s, row(ts, seq)) FILTER (s IS NOT NULL) AS s, arg_max(is_false_positive, row(ts, seq)) FILTER (is_false_positive IS NOT NULL) AS fp, arg_max(reason, row(ts, seq)) FILTER (reason IS NOT NULL) AS reason FROM e GROUP BY 1)
SELECT f.finding_id, coalesce(l.s, f.status) AS status, coalesce(l.fp, f.is_false_positive) AS is_false_positive, l.reason FROM findings f LEFT JOIN l USING (finding_id)"""
ORACLES["q14_cancel"] = f"""
WITH {facts.sql("scans", "cancels")}
SELECT scan_id, created_by_id, CASE WHEN EXISTS (SELECT 1 FROM cancels c WHERE c.scan_id = s.scan_id AND c.user_id = s.created_by_id) THEN 'cancelled' ELSE status END AS status FROM scans s"""

# dashboards

_F = f"WITH {facts.sql('findings', 'scans')}, {SEV}, {CAT}, mine AS (SELECT f.*, s.name AS scan_name FROM findings f JOIN scans s USING (scan_id) WHERE s.created_by_id = {OWNER})"
_S = f"WITH {facts.sql('scans')}, mine AS (SELECT * FROM scans WHERE created_by_id = {OWNER})"
_MEAN = "coalesce(round_even(avg(risk_score) FILTER (status = 'completed'), 1), 0.0)"
_RECENT = f"count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)"
ORACLES["q1_total_scans"] = f"{_S} SELECT count(*) AS total_scans FROM mine"
ORACLES["q2_active_scans"] = f"{_S} SELECT count(*) AS active_scans FROM mine WHERE status = 'running'"
_DIST = "SELECT d.severity, count(m.finding_id) AS n FROM severity_dim d LEFT JOIN mine m ON m.severity = d.severity AND NOT m.is_false_positive GROUP BY 1"
ORACLES["q3_severity_distribution"] = f"{_F} {_DIST}"
ORACLES["q4_mean_risk"] = f"{_S} SELECT {_MEAN} AS risk_score FROM mine"
ORACLES["q5_owasp_rollup"] = f"{_F} SELECT d.owasp, count(m.finding_id) AS n FROM category_dim d LEFT JOIN mine m ON m.category = d.category AND NOT m.is_false_positive GROUP BY 1"
ORACLES["q6_recent_scans"] = f"{_S} SELECT {_RECENT} AS recent_scans_7d FROM mine"
_TREND = f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, {_COUNTS} FROM mine WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1"
ORACLES["q7_trends"] = f"{_F} {_TREND}"
_TOP = "SELECT m.*, d.low, d.high FROM mine m JOIN severity_dim d USING (severity) WHERE status = 'open' AND NOT is_false_positive ORDER BY {0} DESC, cvss_score DESC NULLS FIRST, finding_id LIMIT {1}"
_TOPC = "finding_id, title, severity, cvss_score, scan_name"
ORACLES["q8_top_findings"] = f"{_F} SELECT {_TOPC} FROM ({_TOP.format('d.ord', 10)})"
ORACLES["q8_top_findings_by_risk"] = f"{_F} SELECT {_TOPC} FROM ({_TOP.format('d.score', 10)})"
ORACLES["q9_cwe_breakdown"] = f"{_F} SELECT cwe_id, cwe_id AS name, count(*) AS n FROM mine WHERE cwe_id IS NOT NULL AND NOT is_false_positive GROUP BY 1 ORDER BY n DESC, cwe_id LIMIT 20"
ORACLES["q10_list_scans"] = f"{_S} SELECT scan_id, name, status, risk_score FROM mine WHERE status = 'completed' ORDER BY created_at DESC, scan_id LIMIT 20 OFFSET 5"
ORACLES["q11_list_findings"] = f"{_F} SELECT finding_id, severity, category, status FROM findings WHERE scan_id = 7 AND severity = 'HIGH' ORDER BY finding_id LIMIT 50"
ORACLES["q12_lookup"] = f"{_S} SELECT scan_id, name, status FROM scans WHERE scan_id = 7"
ORACLES["q15_taken"] = f"WITH {facts.sql('users')} SELECT * FROM users WHERE email = 'user3@example.org' OR username = 'user5'"
ORACLES["q16_at_least"] = f"WITH {facts.sql('users')} SELECT user_id, role FROM users WHERE role IN ('admin', 'security_engineer', 'bug_bounty_hunter')"
_WIDE = ", ".join([f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in dims.SEVERITY_NAMES] + [f"count(*) FILTER (owasp = '{x}') AS owasp_{x.split(':')[0].lower()}" for x in sorted({x for _, x in dims.CATEGORIES})])
ORACLES["dashboard_summary"] = f"""{_F}, a AS (SELECT count(*) AS total_scans, count(*) FILTER (status = 'running') AS active_scans, {_RECENT} AS recent_scans_7d, {_MEAN} AS risk_score FROM scans WHERE created_by_id = {OWNER}),
b AS (SELECT count(*) AS total_findings, {_WIDE} FROM mine JOIN category_dim USING (category) WHERE NOT is_false_positive) SELECT * FROM a, b"""
ORACLES["f1_pie"] = f"{_F} SELECT * FROM ({_DIST}) WHERE n > 0"
ORACLES["f2_merged_low"] = f"{_F} SELECT date, critical, high, medium, low + info AS low_info FROM ({_TREND})"
ORACLES["f2_risk_bands"] = f"{_S} SELECT CASE WHEN risk_score > 70 THEN 'high' WHEN risk_score > 40 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM scans GROUP BY 1"
ORACLES["f3_labelled"] = f"{_F} SELECT regexp_extract(file_path, '[^/]*$') AS file_name, CASE WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' ELSE 'other' END AS cvss_band, count(*) AS n FROM findings GROUP BY ALL"
ORACLES["f4_potential_bounty"] = f"{_F} SELECT CAST(coalesce(sum((low + high) / 2), 0) AS DOUBLE) AS potential FROM ({_TOP.format('d.score', 20)})"
ORACLES["f5_radar"] = f"""{_F}, c AS (SELECT max(n) FILTER (severity = 'CRITICAL') AS c, max(n) FILTER (severity = 'HIGH') AS h, max(n) FILTER (severity = 'MEDIUM') AS m, max(n) FILTER (severity = 'LOW') AS l FROM ({_DIST}))
SELECT subject, CAST(least(100, v) AS BIGINT) AS value FROM (SELECT unnest(['Injection', 'Auth', 'Access Ctrl', 'Crypto', 'Config', 'Data Exposure']) AS subject, unnest([(c + h) * 10, h * 8, c * 12, m * 5, l * 3, m * 6]) AS v FROM c)"""
ORACLES["f6_bounty_range"] = f"{_F} SELECT severity, CASE WHEN high > 0 THEN '$' || low || ' - $' || high END AS bounty_range, count(*) AS n FROM findings JOIN severity_dim USING (severity) GROUP BY ALL"
ORACLES["f7_client_filter"] = f"{_F} SELECT finding_id, severity, category FROM findings WHERE severity = 'HIGH' AND category = 'xss'"
ORACLES["f8_completed_among_newest"] = f"{_S} SELECT scan_id, status FROM (SELECT * FROM scans ORDER BY created_at DESC, scan_id LIMIT 30) WHERE status = 'completed'"
ORACLES["f13_severity_select"] = f"{_F} SELECT severity, count(*) AS n FROM findings GROUP BY 1"
ORACLES["f9_submission_report"] = f"""{_F}, s AS (SELECT *, finding_id % 1000 AS seq FROM findings)
SELECT scan_id, '# Security report' || chr(10) || chr(10) || 'Total findings: ' || count(*) || chr(10) || chr(10) || coalesce(string_agg(
  '## ' || seq || '. ' || title || chr(10) || chr(10) || 'Severity: ' || severity || ' | CWE: ' || coalesce(cwe_id, 'N/A') || ' | OWASP: ' || owasp_category || chr(10) || chr(10) || 'File: ' || file_path || chr(10) || 'Line: ' || line_start || chr(10) || 'Detection: ' || detection_method || chr(10),
  chr(10) || '---' || chr(10) ORDER BY seq) FILTER (seq <= 10), '') AS report FROM s GROUP BY scan_id"""
ORACLES["f10_executive_report"] = f"""{_F}, c AS ({_risk("scan_id", "findings")})
SELECT scan_id, concat('# Executive summary', chr(10), chr(10), 'Risk score: ', risk_score, '/100', chr(10), chr(10), '| Severity | Count | Due |', chr(10), '|---|---|---|', chr(10), '| Critical | ', critical, ' | at once |', chr(10), '| High | ', high, ' | 7 days |', chr(10),
  '| Medium | ', medium, ' | 30 days |', chr(10), '| Low | ', low, ' | best effort |', chr(10), chr(10), CASE WHEN critical > 0 THEN 'Critical risk: fix before any deployment.' ELSE 'Risk is manageable: fix high findings first.' END) AS report FROM c"""
_SARIF = "SELECT scan_id, CAST(finding_id % 1000 AS INT) AS seq, coalesce(cwe_id, 'UNKNOWN') AS rule_id, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'warning' ELSE 'note' END AS level, title AS message, file_path AS uri, line_start AS start_line FROM findings"
ORACLES["f11_sarif_results"] = f"{_F} {_SARIF}"
ORACLES["f11_sarif"] = f"{_F} SELECT scan_id, '2.1.0' AS version, arg_min(rule_id, seq) AS first_rule, CAST(arg_min(start_line, seq) AS VARCHAR) AS first_line FROM ({_SARIF}) GROUP BY scan_id"
ORACLES["f12_developer_guide"] = f"""{_F}
SELECT scan_id, '# Developer guide' || chr(10) || chr(10) || string_agg('## ' || title || chr(10) || 'File: ' || file_path || ':' || line_start || chr(10) || 'Fix: Apply security best practices', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY finding_id) AS report FROM findings GROUP BY scan_id"""
ORACLES["stream_progress_latest"] = f"""
WITH {facts.sql("progress")}
SELECT scan_id, status, phase, progress, findings, status IN ('completed', 'failed', 'cancelled') AS done FROM progress QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, seq DESC) = 1"""
_PHASE = "CASE " + " ".join(f"WHEN progress >= {at} THEN '{name}'" for at, name in reversed(dims.PHASES)) + " END"
ORACLES["stream_phases"] = f"WITH {facts.sql('progress')} SELECT {_PHASE} AS phase, count(*) AS n FROM progress GROUP BY 1"
ORACLES["stream_sessions"] = f"""
WITH {facts.sql("progress")},
m AS (SELECT scan_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY scan_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM progress),
g AS (SELECT *, sum(new) OVER (PARTITION BY scan_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT scan_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY scan_id, s"""
