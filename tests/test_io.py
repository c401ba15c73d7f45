import io
import json
import zipfile

from pyspark.sql import functions as F

from rulestream.operators import dependencies, enrich, findings, triage
from rulestream.sources import files, sinks
from rulestream.streaming import progress


def test_directory_and_zip(spark, tmp_path):
    for name, data in {"a.py": b"exec(x)\n", "node_modules/b.js": b"x", ".git/c.py": b"x", "sub/d.min.js": b"x", "sub/e.go": b"\xff ok", "sub/Dockerfile": b"FROM a"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r["path"]: (r["language"], r["content"]) for r in files.read_directory(spark, str(tmp_path)).collect()}
    assert rows == {"a.py": ("python", "exec(x)\n"), "sub/e.go": ("go", "\ufffd ok"), "sub/Dockerfile": ("dockerfile", "FROM a")}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("p/q.py", "eval(x)")
        z.writestr("p/r.png", "x")
    (tmp_path / "u.zip").write_bytes(buffer.getvalue())
    assert [tuple(r) for r in files.from_bytes(files.read_zip(spark, str(tmp_path / "u.zip"))).collect()] == [("p/q.py", "python", "eval(x)")]


def test_findings_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t" * 600, "s", "supply_chain", "WEIRD", "/base/x.py"), (2, "t", "s" * 3000, "xss", "LOW", "/other/y.py")], "scan_id long, title string, snippet string, category string, severity string, file_path string")
    sinks.write_findings(rows, str(tmp_path / "f"), "/base")
    one = sinks.read_findings(spark, str(tmp_path / "f"), 1).first()
    assert (len(one["title"]), one["category"], one["severity"], one["file_path"], one["status"]) == (500, "other", "MEDIUM", "x.py", "open")
    assert len(sinks.read_findings(spark, str(tmp_path / "f"), 2).first()["snippet"]) == 2000
    plan = sinks.read_findings(spark, str(tmp_path / "f"), 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(scan_id" in plan
    sinks.write_reports(spark.createDataFrame([(1, "# r\nx")], "scan_id long, report string"), str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r" / "scan_id=1")).collect()] == ["# r", "x"]


def test_manifests(spark):
    rows = [
        ("m/requirements.txt", "# c\nFlask[async]>=1.2\nbare\n\nReq == 2"), ("m/package.json", '{"dependencies": {"a": "^1.2"}, "devDependencies": {"b": "*"}}'), ("m/go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire c/d v2.0"),
        ("m/Gemfile", "gem 'rails', '~> 6'\ngem \"pg\"\n  gem 'no'"), ("m/composer.json", '{"require": {"a/b": "^2"}, "require-dev": {"c": "3"}}'), ("m/Cargo.toml", '[package]\nname = "x"\nserde = "1.0"\ntok = { version = "1" }'), ("m/bad/package.json", "{nope"), ("m/pom.xml", "<x/>"),
    ]
    got = dependencies.packages(dependencies.manifests(spark.createDataFrame([(p, None, c) for p, c in rows], "path string, language string, content string")))
    assert sorted((r["path"], r["name"], r["version"], r["line"]) for r in got.collect()) == [
        ("m/Cargo.toml", "serde", "1.0", 3), ("m/Gemfile", "pg", "unknown", 2), ("m/Gemfile", "rails", "~> 6", 1), ("m/composer.json", "a/b", "^2", 0), ("m/composer.json", "c", "3", 0),
        ("m/go.mod", "github.com/a/b", "1.2.3", 3), ("m/package.json", "a", "1.2", 0), ("m/package.json", "b", "*", 0), ("m/requirements.txt", "flask", "1.2", 2), ("m/requirements.txt", "req", "2", 5),
    ]


def test_one_look_alike_survives_per_json_manifest(spark):
    rows = spark.createDataFrame([("package.json", None, '{"dependencies": {"expres": "1", "reac": "2"}}')], "path string, language string, content string")
    assert findings.dedup(findings.union([dependencies.dependency_findings(rows)])).count() == 1


def test_replies(spark):
    raws = ['{"is_valid": false}', "text ```json\n{\"confidence\": 0.9}\n``` end", "so {\"exploitability\": \"LOW\"} there", "nothing", "", "[1, 2]"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", enrich.overlay(F.col("raw"), F.col("i") == 4).alias("o")).orderBy("i").collect()
    assert [(r["o"]["is_valid"], r["o"]["confidence"], r["o"]["exploitability"]) for r in rows] == [(False, 0.7, "MEDIUM"), (True, 0.9, "MEDIUM"), (True, 0.7, "LOW"), (True, 0.4, "MEDIUM"), (True, 0.5, "MEDIUM"), (True, 0.4, "MEDIUM")]


def test_a_failing_provider_leaves_the_defaults(spark):
    def broken(_):
        raise RuntimeError

    rows = spark.createDataFrame([(1, 1, "HIGH", "t", "xss", "f", "s", None, None, 0.8)], "scan_id int, seq int, severity string, title string, category string, file_path string, snippet string, source string, sink string, confidence double")
    assert enrich.enrich(rows, "deep", broken).first()["confidence"] == 0.5
    assert enrich.enrich(rows, "deep", None).first()["ai_analyzed"] is False


def test_the_provider_is_asked_once_about_each_of_the_first_severe_findings(spark, tmp_path):
    def provider(prompt):
        with open(tmp_path / "calls", "a") as out:
            out.write(f"{json.loads(prompt)['title']}\n")
        return '{"is_valid": false}' if "t3 " in prompt else '{"confidence": 0.9}'

    scans = [1] * 13 + [2] * 3 + [None] * 2
    kinds = ["LOW", *["HIGH"] * 12, "CRITICAL", "INFO", "HIGH", "HIGH", "LOW"]
    rows = [(s, i, k, f"t{i} ", "xss", "f", "s", None, None, 0.8) for i, (s, k) in enumerate(zip(scans, kinds))]
    found = spark.createDataFrame(rows, "scan_id int, seq int, severity string, title string, category string, file_path string, snippet string, source string, sink string, confidence double")
    asked = [*range(1, 11), 13, 15, 16]
    said = enrich.enrich(found, "deep", provider).select("seq", "ai_analyzed", "confidence").collect()
    assert sorted(tuple(r) for r in said) == [(i, i in asked, 0.9 if i in asked else 0.8) for i in range(18) if i != 3]
    assert sorted((tmp_path / "calls").read_text().split()) == sorted(f"t{i}" for i in asked)


def test_triage_order(spark):
    f = spark.createDataFrame([(1, "open", False), (2, "open", False)], "finding_id long, status string, is_false_positive boolean")
    log = spark.createDataFrame([(1, 1, 1, None, True, "r"), (1, 2, 1, None, False, None), (2, 1, 1, "bad", None, None), (2, 1, 2, "fixed", None, None)], "finding_id long, ts long, seq long, status string, is_false_positive boolean, reason string")
    assert sorted(tuple(r) for r in triage.apply_triage(f, log).select("finding_id", "status", "is_false_positive", "reason").collect()) == [(1, "false_positive", False, "r"), (2, "fixed", False, None)]


def test_empty_findings(spark):
    from rulestream.plans import analytics
    from rulestream.sources import facts

    d = "/root/testdata/sf0.001"
    none, scans = facts.findings(spark, d).limit(0), facts.scans(spark, d)
    assert {tuple(r) for r in analytics.severity_distribution(none, scans, 1).collect()} == {(s, 0) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")}
    assert analytics.scan_totals(scans.limit(0), 1, facts.AS_OF).first()["risk_score"] == 0.0


def test_progress_stream(spark, tmp_path):
    schema = "scan_id bigint, ts timestamp, seq bigint, status string, phase string, progress int, findings int"
    one = "SELECT CAST({0} AS BIGINT) scan_id, TIMESTAMP '2024-01-01 00:00:{1}' ts, CAST({1} AS BIGINT) seq, '{2}' status, 'parsing' phase, {1} progress, 0 findings"
    spark.sql(f"{one.format(1, 10, 'running')} UNION ALL {one.format(2, 11, 'running')}").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.read_progress(spark, str(tmp_path / "in"), schema)
    progress.follow(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    spark.sql(one.format(1, 20, "completed")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    progress.follow(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert {(r["scan_id"], r["progress"], r["done"]) for r in progress.followed(spark, str(tmp_path / "out")).collect()} == {(1, 20, True), (2, 11, False)}


def test_files_scanned_as_they_arrive(spark, tmp_path):
    spark.createDataFrame([("a.py", "python", "exec(x)")], "path string, language string, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, language string, content string").parquet(str(tmp_path / "in"))
    progress.scan_arrivals(stream, findings.scan, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [r["rule_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["PY_CMDI_004"]


def test_windowed_trend(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP '2024-01-01 05:00:00' created_at, 'HIGH' severity UNION ALL SELECT TIMESTAMP '2024-01-09 05:00:00', 'LOW'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.windowed_trend(spark.readStream.schema("created_at timestamp, severity string").parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("append").format("memory").queryName("trend_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r["severity"] for r in spark.sql("SELECT * FROM trend_test").collect()] in ([], ["HIGH"])
