"""Source lines and files derived from the ``events`` table, for tests and benchmarks.

A user's events in order are the lines of a file; each event picks a line from its language's list,
which holds the rules' own samples, lines for the taint and context checks, and neutral ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulestream.catalogs.rules import RULES

LANGUAGES = (("python", ".py"), ("javascript", ".js"), ("java", ".java"), ("php", ".php"), ("go", ".go"), ("typescript", ".ts"), ("yaml", ".yaml"), ("ruby", ".rb"))
DIRS = ("src", "app/graphql", "tests", "lib/schema", "pkg")

_COMMON = """

    return result
x = 1
value = compute(value)
// plain remark
# plain remark
done()
""".strip("\n").split("\n")

_OWN = {
    "python": """
uid = request.args.get("id")
name = input("name")
data = request.json
cursor.execute(uid)
os.system(name)
item = Model.objects.get(id=uid)
if item.owner != request.user:
safe = shlex.quote(name)
session.execute(int(uid))
out = open(name)
from flask import Flask
import django
def handle(data):
class Handler(object):
amount = 5
stripe.charge(amount)
if amount > 0:
coupon = find(code)
if balance >= amount:
wallet.withdraw(balance)
with lock:
reset_token = str(time())
token = random.random()
expires = timedelta(hours=1)
verify_otp(code)
max_attempts = 3
user.role = new_role
require_admin(user)
user.email = update(email)
check_password(user)
jwt.decode(t, verify=False)
is_admin = True
Model(**request)
cleaned_data = form
render_template_string(data)
""",
    "javascript": """
const id = req.query.id;
let q = req.body.q;
db.query(id);
box.innerHTML = q;
Object.assign(user, req.body);
const safe = parseInt(id);
eval(req.body.code);
User.findById(id);
function run(a) {
class Box extends Base {
import React from 'react';
const express = require('express');
pick(req.body, names);
setRole(user, "x");
fetch(q);
introspection: true
""",
    "java": """
String id = request.getParameter("id");
id = request.getHeader("h");
executeQuery(id);
new File(id);
out.println(request.getParameter("x"));
Integer.parseInt(id);
import org.springframework.boot;
public class Main {
public static void main(String[] args) {
BeanUtils.copyProperties(a, b);
""",
    "php": """
$id = $_GET['id'];
$name = $_POST['name'];
mysqli_query($c, $id);
system($name);
echo htmlspecialchars($name);
include($id);
use Illuminate\\Support;
function handle($x) {
class Page {
$model->fill($request->all());
""",
    "go": """
id := r.FormValue("id")
name = c.Query("name")
db.Query(id)
exec.Command(name)
http.Get(id)
n := strconv.Atoi(id)
import "github.com/gin-gonic/gin"
func main() {
type Box struct {
c.ShouldBindJSON(&x)
""",
    "typescript": """
const id = req.query.id;
import { x } from '@angular/core';
class Service {
introspection = enabled
""",
    "yaml": """
services:
image: base:1
graphql: on
max_depth: 5
password: "changeme99"
""",
    "ruby": """
require 'rails'
gem "x"
Item.find_by_id(params[:id])
""",
}


def snippets() -> list[tuple[str, int, int, str]]:
    """(language, k, number of lines of the language, text)."""
    rows = []
    for language, _ in LANGUAGES:
        texts = [*_OWN[language].strip("\n").split("\n"), *(r.sample for r in RULES if not r.languages or language in r.languages), *_COMMON]
        rows += [(language, k, len(texts), t) for k, t in enumerate(texts)]
    return rows


def lines(spark: SparkSession, sf_dir: str, users_per_file: int = 1) -> DataFrame:
    """(path, language, line_no, text); with more users per file the files are longer."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(f"user_id div {users_per_file}").alias("file_id"), "event_id", "ts")
    language = F.element_at(F.array(*(F.lit(x) for x, _ in LANGUAGES)), (F.col("file_id") % len(LANGUAGES) + 1).cast("int"))
    suffix = F.element_at(F.array(*(F.lit(x) for _, x in LANGUAGES)), (F.col("file_id") % len(LANGUAGES) + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, DIRS)), (F.col("file_id") % len(DIRS) + 1).cast("int"))
    events = events.select(F.concat(folder, F.lit("/f"), F.col("file_id").cast("string"), suffix).alias("path"), language.alias("language"), "event_id", "ts")
    rows = snippets()
    known = F.broadcast(spark.createDataFrame(rows, "language string, k int, n int, text string"))
    sizes = {x: n for x, _, n, _ in rows}
    n = F.element_at(F.create_map(*(F.lit(v) for x in sizes.items() for v in x)), F.col("language"))
    numbered = events.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("ts", "event_id")))
    numbered = numbered.withColumn("k", (F.col("event_id") % n).cast("int"))
    return numbered.join(known.drop("n"), ["language", "k"]).select("path", "language", "line_no", "text")


def files(spark: SparkSession, sf_dir: str, users_per_file: int = 1) -> DataFrame:
    """(path, language, content) with the lines joined by newlines."""
    rows = lines(spark, sf_dir, users_per_file).groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return rows.select("path", "language", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A SQL row list as a named table expression."""
    one = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


def lines_sql(users_per_file: int = 1) -> str:
    """The same lines for DuckDB, as common table expressions ``lines`` and ``files``."""
    pick = lambda items, m: "[" + ", ".join(map(quote, items)) + f"][file_id % {m} + 1]"
    langs, n = LANGUAGES, len(LANGUAGES)
    return f"""
snip AS (SELECT * FROM {values(snippets(), "language, k, n, text")}),
ev AS (SELECT user_id // {users_per_file} AS file_id, event_id, ts FROM events),
named AS (SELECT {pick(DIRS, len(DIRS))} || '/f' || file_id || {pick([s for _, s in langs], n)} AS path, {pick([x for x, _ in langs], n)} AS language, event_id, ts FROM ev),
numbered AS (SELECT path, language, event_id, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS line_no FROM named),
lines AS (SELECT m.path, m.language, m.line_no, s.text FROM numbered m JOIN snip s ON s.language = m.language AND s.k = m.event_id % s.n),
files AS (SELECT path, language, string_agg(text, chr(10) ORDER BY line_no) AS content, count(*) AS n_lines FROM lines GROUP BY path, language)"""
