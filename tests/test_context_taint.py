import pytest
from pyspark.sql import functions as F

from rulestream.catalogs.checks import CHECKS
from rulestream.functions.text import snippet
from rulestream.operators import context, taint


def hits(spark, check_id, content, path="src/a.py", language="python"):
    check = [c for c in CHECKS if c.id == check_id]
    files = spark.createDataFrame([(path, language, content)], "path string, language string, content string")
    return [(r["line"], r["end"]) for r in context.context_hits(files, check).select("line", "end").orderBy("line", "pat").collect()]


PAD = "pass\n"


@pytest.mark.parametrize(
    "check_id,anchor,guard,before,after",
    [
        ("BL_MASS_ASSIGN_001", "Model(**request)", "cleaned_data", 4, 5),
        ("BL_PAYMENT_001", "charge(x)", "validate amount", 14, 0),
        ("BL_COUPON_001", "coupon = 1", "max_uses", 4, 15),
        ("BL_PWRESET_002", "reset_token = 1", "expires", None, 15),
        ("BL_OTP_001", "verify otp", "throttle", 2, 15),
        ("BL_PRIVESC_001", "u.role = r", "require_admin", 19, 0),
        ("BL_ATO_001", "email = 1", "password", 14, 5),
    ],
)
def test_windows_end_where_they_should(spark, check_id, anchor, guard, before, after):
    if before:
        assert not hits(spark, check_id, f"{guard}\n" + PAD * (before - 1) + anchor)
        assert hits(spark, check_id, f"{guard}\n" + PAD * before + anchor)
    if after:
        assert not hits(spark, check_id, f"{anchor}\n" + PAD * (after - 1) + guard)
        assert hits(spark, check_id, f"{anchor}\n" + PAD * after + guard)
    assert hits(spark, check_id, anchor)


def test_fetch_by_id(spark):
    assert hits(spark, "BL_IDOR_001", "x = find_by_id(request.id)\nshow(x)") == [(1, 2)]
    assert not hits(spark, "BL_IDOR_001", "x = find_by_id(7)\nshow(x)")
    assert not hits(spark, "BL_IDOR_001", "x = find_by_id(request.id)\n" + PAD * 19 + "owner")
    assert hits(spark, "BL_IDOR_001", "x = find_by_id(request.id)\n" + PAD * 20 + "owner")
    assert hits(spark, "BL_IDOR_001", "x = find_by_id(request.id) # owner")  # the anchor's own line doesn't count


def test_race_ends_at_the_act_and_locks_stop_it(spark):
    assert hits(spark, "BL_RACE_001", "if balance > x:\n  pass\n  withdraw(balance)") == [(1, 3)]
    assert not hits(spark, "BL_RACE_001", "if balance > x:\n  with lock:\n  withdraw(balance)")
    assert not hits(spark, "BL_RACE_001", "if balance > x:\n" + PAD * 20 + "withdraw(balance)")


def test_file_and_path_limits(spark):
    assert hits(spark, "BL_COUPON_001", "coupon\n" * 3) == [(1, 1)]
    assert hits(spark, "BL_GRAPHQL_002", "type Query", "api/schema.py") == [(1, 1)]
    assert not hits(spark, "BL_GRAPHQL_002", "max_depth", "api/schema.py") and not hits(spark, "BL_GRAPHQL_002", "x", "api/other.py")
    assert not hits(spark, "BL_HARDCODED_ADMIN_001", 'role = "admin"', "tests/a.py") and hits(spark, "BL_HARDCODED_ADMIN_001", 'role = "admin"') == [(1, 1)]
    assert not hits(spark, "BL_PRIVESC_001", "user.is_admin = True")  # its own words are guards


def flows(spark, content, language="python"):
    files = spark.createDataFrame([("a", language, content)], "path string, language string, content string")
    return [(r["kind"], r["source_line"], r["sink_line"], r["flaw"]) for r in taint.flows(files).orderBy("flow_ord").collect()]


def test_traced_flows_reach_99_lines(spark):
    assert ("traced", 1, 100, "command_injection") in flows(spark, "v = input()\n" + PAD * 98 + "os.system(v)")
    assert not flows(spark, "v = input()\n" + PAD * 99 + "os.system(v)")


def test_direct_sanitized_and_unknown(spark):
    assert flows(spark, "os.system(input())") == [("direct", 1, 1, "command_injection")]
    assert not flows(spark, "os.system(shlex.quote(input()))")
    assert not flows(spark, "os.system(input())", "typescript") and not flows(spark, "os.system(input())", "ruby")
    assert not flows(spark, "  id = r.Body\ndb.Query(id)", "go")  # an indented assignment names no variable


def test_first_flow_wins(spark):
    from rulestream.operators import findings

    files = spark.createDataFrame([("a", "python", "v = input()\ndb.execute(v)\ncursor.execute(v)")], "path string, language string, content string")
    rows = findings.dedup(taint.taint_findings(files)).collect()
    assert [(r["rule_id"], r["line_start"], r["line_end"], r["confidence"]) for r in rows] == [("TAINT_SQL_INJECTION", 1, 2, 0.75)]


def test_lines_are_lower_cased_once_for_all_checks(spark):
    files = spark.createDataFrame([("a.py", "python", "x = 1\n")], "path string, language string, content string")
    plan = context.context_findings(files)._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(lambda") == 1


def test_line_numbers_of_snippets_are_padded_and_never_cut(spark):
    numbers = [1, 42, 999, 1000, 12345]
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, numbers))).alias("n")).select(snippet(F.transform(F.sequence(F.lit(1), F.lit(12345)), lambda i: F.lit("x")), F.col("n"), F.col("n"), 0)).collect()
    assert [r[0] for r in rows] == [f">>> {n:4d} | x" for n in numbers]
