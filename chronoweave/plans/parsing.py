"""Parsers over texts that are put together from the tables' columns, so that SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave import adapters as A
from chronoweave.functions import console as X
from chronoweave.functions import idents as N
from chronoweave.operators.association import similar_names
from chronoweave.sources import artifacts as S

from .registry import query


def _lines(spark, sf_dir):
    """Orders' lines: (l_orderkey, q) with whole quantities."""
    return A.raw(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"), "l_partkey", "l_suppkey")


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]+)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM h GROUP BY ALL""")
def href_edges(spark, sf_dir):
    links = F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]+)"'), F.lit(1)))
    return A.raw(spark, sf_dir, "pages").select("page_id", links.alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, left(sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: x <> ''), chr(10))), 16) AS content_hash FROM documents""")
def content_hash(spark, sf_dir):
    return A.raw(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'TypeError|cannot_read_property' WHEN 1 THEN 'AssertionError|to_equal' WHEN 2 THEN 'Error|' || replace(p_name, ' ', '_') || '_failed' WHEN 3 THEN 'RangeError|unknown' END AS signature FROM part""")
def error_signature(spark, sf_dir):
    p = A.raw(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    out = (
        F.when(k == 0, F.concat(F.lit("run\n  TypeError: Cannot read properties of undefined (reading '"), "p_name", F.lit("')\n at x")))
        .when(k == 1, F.concat(F.lit("AssertionError: expected "), "p_partkey", F.lit(" to equal 7")))
        .when(k == 2, F.concat(F.lit("log\nError: "), "p_name", F.lit(" failed "), "p_partkey", F.lit(" {a: 1}")))
        .when(k == 3, "RangeError: 17 'text' [1, 2]\nError: second")
        .otherwise(F.concat(F.lit("no header, MyError: "), "p_name"))
    )
    return p.select(F.col("p_partkey").alias("id"), X.error_signature(out).alias("signature"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS run, 'py::src.m' || l_suppkey || '.f' || l_partkey % 10 AS name FROM lineitem WHERE l_orderkey % 2 = 0
UNION SELECT DISTINCT l_orderkey, 'js_ts::src/m' || l_suppkey || '.g' || l_partkey % 10 FROM lineitem WHERE l_orderkey % 2 = 1) SELECT run, count(*) AS frames, min(name) AS least, max(name) AS most FROM f GROUP BY 1""")
def stack_frames(spark, sf_dir):
    """Traces with a frame for each line of an order, and foreign frames between them."""
    li = _lines(spark, sf_dir)
    py = F.format_string('  File "/root/p/src/m%d.py", line %d, in f%d\n    x()\n  File "/usr/lib/python3.11/json.py", line 3, in loads', "l_suppkey", "n", F.col("l_partkey") % 10)
    js = F.format_string("    at g%d (/root/p/src/m%d.ts:%d:7)\n    at Module._compile (node:internal/modules:1:2)\n    at h (/root/p/tests/a.ts:1:1)", F.col("l_partkey") % 10, "l_suppkey", "n")
    trace = F.array_join(F.collect_list(F.when(F.col("l_orderkey") % 2 == 0, py).otherwise(js)), "\n")
    rows = li.groupBy(F.col("l_orderkey").alias("run")).agg(trace.alias("out"))
    names = X.stack_names(F.col("out"), F.lit("/root/p"))
    return rows.select("run", names.alias("s")).select("run", F.size("s").cast("long").alias("frames"), F.element_at("s", 1).alias("least"), F.element_at("s", -1).alias("most"))


@query("""WITH r AS (SELECT l_orderkey AS run, CAST(sum(l_quantity) AS BIGINT) AS p, count(*) AS f FROM lineitem GROUP BY 1)
SELECT run, CASE run % 5 WHEN 0 THEN 'pytest' WHEN 1 THEN 'jest' WHEN 2 THEN 'cargo' WHEN 3 THEN 'mocha' ELSE 'go_test' END AS runner, CASE WHEN run % 5 = 4 THEN 1 WHEN run % 5 = 2 THEN p + 1 ELSE p END AS passed, CASE WHEN run % 5 = 4 THEN 2 ELSE f END AS failed,
CASE WHEN run % 5 IN (0, 2) THEN 2 WHEN run % 5 IN (1, 3) THEN 4 ELSE 0 END::BIGINT AS skipped FROM r""")
def test_summary(spark, sf_dir):
    rows = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("run")).agg(F.sum("q").alias("p"), F.count(F.lit(1)).alias("f"))
    k = F.col("run") % 5
    say = lambda text, *c: F.format_string(text, *c)
    out = (
        F.when(k == 0, say("== 99 passed ==\nx\n=== %d failed, %d passed, 2 skipped in 3.1s ===\nend", "f", "p"))
        .when(k == 1, say("Tests: 1 failed\nTests:  %d failed, 4 pending, %d passed, 900 total\nTime: 1 s", "f", "p"))
        .when(k == 2, say("test result: ok. 1 passed; 0 failed; 2 ignored; 0 measured\ntest result: FAILED. %d passed; %d failed; 0 ignored", "p", "f"))
        .when(k == 3, say("  %d passing (2s)\n  4 pending\n  %d failing", "p", "f"))
        .otherwise("ok  \tpkg/a\t0.1s\nFAIL\tpkg/b\n--- FAIL: TestX\nPASS")
    )
    command = F.element_at(F.array(*map(F.lit, ("python -m pytest -q", "npx vitest run", "cargo test", "npm run test", "go test ./..."))), (k + 1).cast("int"))
    found = X.test_summary(command, out)
    return rows.select("run", found.alias("r")).select("run", "r.runner", "r.passed", "r.failed", "r.skipped")


@query("""SELECT l_orderkey AS run, 'tests.t' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN '.TestC' ELSE '' END AS classname, 'test_' || l_partkey || '[a-1]' AS name, 'tests/t' || l_suppkey || '.py' AS file_path,
CASE l_linenumber WHEN 1 THEN 'passed' WHEN 2 THEN 'failed' WHEN 3 THEN 'error' WHEN 4 THEN 'skipped' WHEN 5 THEN 'skipped' ELSE 'passed' END AS status FROM lineitem WHERE l_linenumber <= 6""")
def test_cases_verbose(spark, sf_dir):
    li = _lines(spark, sf_dir)
    word = F.element_at(F.array(*map(F.lit, ("PASSED", "FAILED", "ERROR", "SKIPPED", "XFAIL", "XPASS", "WHAT"))), F.col("n").cast("int"))
    line = F.concat(F.format_string("tests/t%d.py::", "l_suppkey"), F.when(F.col("n") % 2 == 0, "TestC::").otherwise(""), F.format_string("test_%d[a-1] ", "l_partkey"), word, F.lit(" [ 12%]"))
    rows = li.groupBy(F.col("l_orderkey").alias("run")).agg(F.concat(F.lit("== session ==\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\nend")).alias("out"))
    return rows.select("run", F.explode(X.test_cases(F.col("out"))).alias("c")).select("run", "c.classname", "c.name", "c.file_path", "c.status")


@query("""SELECT l_orderkey AS id, 's' || l_orderkey % 50 AS session_id, l_returnflag AS model, round(sum(CASE WHEN l_linenumber % 3 = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0 ELSE 0 END), 4) AS cost_usd,
CAST(sum(CASE WHEN l_linenumber % 3 = 1 THEN l_quantity ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN l_linenumber % 3 = 2 THEN l_quantity ELSE 0 END) AS BIGINT) AS output_tokens FROM lineitem GROUP BY 1, 2, 3""")
def otlp_flatten(spark, sf_dir):
    """A message for each order, whose lines are data points of cost and token metrics."""
    li = A.raw(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 3
    value = F.when(k == 0, F.concat(F.lit('"asDouble": '), F.format_string("%.2f", F.round(F.col("l_extendedprice") * 100) / 100))).otherwise(F.concat(F.lit('"asInt": "'), F.col("l_quantity").cast("long"), F.lit('"')))
    kind = F.when(k == 1, "input").when(k == 2, "output").otherwise("none")
    point = F.concat(F.lit('{"attributes": [{"key": "model", "value": {"stringValue": "'), "l_returnflag", F.lit('"}}, {"key": "type", "value": {"stringValue": "'), kind, F.lit('"}}], '), value, F.lit("}"))
    points = lambda keep: F.array_join(F.collect_list(F.when(keep, point)), ", ")
    rows = li.groupBy("l_orderkey").agg(points(k == 0).alias("c"), points(k > 0).alias("t"))
    body = F.concat(
        F.lit('{"resourceMetrics": [{"resource": {"attributes": [{"key": "session.id", "value": {"stringValue": "s'), F.col("l_orderkey") % 50, F.lit('"}}]}, "scopeMetrics": [{"metrics": ['),
        F.lit('{"name": "agent.cost.usage", "sum": {"dataPoints": ['), "c", F.lit(']}}, {"name": "agent.token.usage", "gauge": {"dataPoints": ['), "t", F.lit(']}}, {"name": "agent.other", "sum": {"dataPoints": ['), "t", F.lit("]}}]}]}]}"),
    )
    out = S.otlp_samples(rows.select(F.col("l_orderkey").alias("id"), body.alias("body")))
    return out.select("id", "session_id", "model", F.round("cost_usd", 4).alias("cost_usd"), "input_tokens", "output_tokens")


@query("""SELECT l_orderkey AS run, 'C' || l_suppkey AS classname, 't' || l_partkey || ' & <x>' AS name, CASE l_linenumber % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE 'passed' END AS status,
CASE l_linenumber % 4 WHEN 0 THEN 'boom ' || l_partkey WHEN 1 THEN 'msg' END AS failure_text FROM lineitem""")
def junit_cases(spark, sf_dir):
    li = _lines(spark, sf_dir)
    k = F.col("n") % 4
    inner = F.when(k == 0, F.format_string("<failure message='m'> boom %d </failure><error/>", "l_partkey")).when(k == 1, F.lit('<error message="msg"></error>')).when(k == 2, "<skipped/>").otherwise("<system-out>a</system-out>")
    case = F.concat(F.format_string('<testcase classname="C%d" name="t%d &amp; &lt;x&gt;" time="0.1">', "l_suppkey", "l_partkey"), inner, F.lit("</testcase>"))
    rows = li.groupBy(F.col("l_orderkey").alias("run")).agg(F.array_join(F.collect_list(case), "\n").alias("body"))
    xml = F.when(F.col("run") % 2 == 0, F.concat(F.lit("<testsuites><testsuite name='a'><testsuite name='b'>"), "body", F.lit("</testsuite></testsuite></testsuites>"))).otherwise(F.concat(F.lit("<testsuite>"), "body", F.lit("</testsuite>")))
    return S.junit_cases(rows.select("run", xml.alias("xml"))).select("run", "classname", "name", "status", "failure_text")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS run, 'coverage::p' || l_suppkey % 5 || '.K' || l_partkey % 7 AS test_case, 'p' || l_suppkey % 5 || '.K' || l_partkey % 7 AS k, l_linenumber FROM lineitem)
SELECT run, test_case, k AS define_name FROM c UNION SELECT run, test_case, k || '.m' || l_linenumber FROM c""")
def cobertura_cover(spark, sf_dir):
    return S.cobertura_entries(cobertura_reports(spark, sf_dir)).distinct()


def cobertura_reports(spark, sf_dir):
    """A report for each order, with a class and method for each line: (run, xml)."""
    li = _lines(spark, sf_dir)
    part = F.format_string('<package name="p%d"><classes><class name="K%d" filename="a.py"><methods><method name="m%d" hits="0"/></methods></class></classes></package>', F.col("l_suppkey") % 5, F.col("l_partkey") % 7, "n")
    return li.groupBy(F.col("l_orderkey").alias("run")).agg(F.concat(F.lit("<coverage><packages>"), F.array_join(F.collect_list(part), ""), F.lit("</packages></coverage>")).alias("xml"))


@query("""WITH l AS (SELECT DISTINCT 'T' || l_orderkey % 100 AS tn, 'src/m' || l_suppkey % 20 || '.py' AS f, CAST(l_quantity AS BIGINT) AS line FROM lineitem WHERE l_linenumber > 1 AND l_quantity >= 5)
SELECT DISTINCT tn || '::m' || regexp_extract(f, '[0-9]+') || '.py' AS test_case, 'd' || line // 5 AS define_name FROM l""")
def lcov_cover(spark, sf_dir):
    """A report for each order; every fifth line of a source begins a function, from line 5."""
    reports, sources = lcov_reports(spark, sf_dir)
    return S.lcov_entries(S.lcov_lines(reports), S.headers(sources))


def lcov_reports(spark, sf_dir):
    """(reports (path, text), sources (path, text))."""
    li = _lines(spark, sf_dir)
    record = F.format_string("SF:src/m%d.py\nDA:%d,%d\nDA:%d,0\nend_of_record", F.col("l_suppkey") % 20, "q", F.when(F.col("n") > 1, 3).otherwise(0), F.col("q") + 1)
    rows = li.groupBy("l_orderkey").agg(F.concat(F.format_string("TN:T%d\n", F.first(F.col("l_orderkey") % 100)), F.array_join(F.collect_list(record), "\n")).alias("text"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(55)), lambda i: F.when(i % 5 == 0, F.concat(F.lit("  def d"), (i / 5).cast("int"), F.lit("(x):"))).otherwise("    pass")), "\n")
    sources = li.select((F.col("l_suppkey") % 20).alias("s")).distinct().select(F.concat(F.lit("src/m"), "s", F.lit(".py")).alias("path"), text.alias("text"))
    return rows.withColumnRenamed("l_orderkey", "path"), sources


@query("""SELECT p_partkey AS id, array_to_string(CASE p_partkey % 4 WHEN 0 THEN ['load_' || p_size, 'Cache', 'Cache.load_' || p_size] WHEN 1 THEN ['clampValue', 'clamp_value', 'normalizers'] WHEN 2 THEN ['ParseTree', 'parse_tree', 'util', 'util.ParseTree'] ELSE ['saves a file', 'utils'] END, '|') AS names FROM part""")
def name_heuristics(spark, sf_dir):
    p, k = A.raw(spark, sf_dir, "part"), F.col("p_partkey") % 4
    cls = F.when(k == 0, "tests.test_store.TestCache").when(k == 1, "tests/unit/normalizers.test.ts").when(k == 2, "pkg.test_util").otherwise("src/utils.spec.js")
    name = F.when(k == 0, F.concat(F.lit("test_load_"), "p_size")).when(k == 1, "clampValue > passes").when(k == 2, "testParseTree").otherwise("should_saves a file")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(X.likely_defines(cls, name), "|").alias("names"))


@query("""WITH n AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''), q AS (SELECT w AS t FROM n UNION SELECT w || 's' FROM n UNION SELECT substr(w, 2) FROM n),
d AS (SELECT t AS text, w AS name, CASE WHEN levenshtein(t, w) <= 2 THEN levenshtein(t, w) ELSE 3 END AS distance FROM q, n WHERE t <> w AND length(t) > 0 AND (levenshtein(t, w) <= 2 OR (length(w) >= 3 AND length(t) >= 3 AND (contains(w, t) OR contains(t, w)))))
SELECT text, name, CAST(distance AS BIGINT) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY text ORDER BY distance, name) <= 3""")
def fuzzy_names(spark, sf_dir):
    words = A.raw(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).where("w <> ''").select(F.lower("w").alias("name")).distinct()
    asked = words.select(F.col("name").alias("text")).union(words.select(F.concat("name", F.lit("s")))).union(words.select(F.expr("substr(name, 2)"))).distinct()
    return similar_names(asked, words)


_PATHS = ["'src/a' || k || '.py'", "'tests/t' || k || '.py'", "'app/page.tsx'", "'lib/x' || k || '.spec.ts'", "'web/node_modules/y.js'", "'pkg/test_z' || k || '.py'", "'legal/terms.tsx'", "'api/generated/c' || k || '.ts'", "'core/e2e/f.js'", "'one_test.py'"]


@query(f"""WITH p AS (SELECT event_id, event_id % 10 AS n, CASE event_id % 10 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_PATHS))} END AS path FROM ev)
SELECT event_id, n IN (1, 3, 5, 8, 9) AS test, n IN (2, 5, 6, 7, 9) AS excluded, n <> 4 AS ingest, CASE WHEN n IN (0, 1, 5, 9) THEN 'py' ELSE 'js_ts' END AS lang,
CASE WHEN n IN (0, 1, 5, 9) THEN replace(replace(path, '.py', ''), '/', '.') ELSE regexp_replace(path, '[.](tsx|ts|js)$', '') END AS module, path IN ('app/page.tsx', 'one_test.py') OR path LIKE 'src/a1%.py' AS scope FROM p""")
def path_rules(spark, sf_dir):
    e = A.determinations(spark, sf_dir).withColumn("event_id", F.col("id") - 1)
    path = F.lit(None).cast("string")
    for i, x in enumerate(_PATHS):
        path = F.when(F.col("event_id") % 10 == i, F.expr(x)).otherwise(path)
    e = e.withColumn("path", path)
    p, root = F.col("path"), F.lit("/r")
    return e.select("event_id", N.is_test_file(p).alias("test"), N.out_of_detection(p).alias("excluded"), N.should_ingest(p).alias("ingest"), N.language(p).alias("lang"), N.module_name(F.concat(F.lit("/r/"), p), root).alias("module"), N.matches_any(p, ["app/*.tsx", "one_test.p[xy]", "src/a1*.py"]).alias("scope"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'commit' WHEN 1 THEN 'rollback' WHEN 2 THEN 'rollback' WHEN 3 THEN 'branch_switch' WHEN 5 THEN 'rollback' WHEN 6 THEN 'commit' END AS kind, event_id % 8 = 7 AS test,
left(sha1(CASE event_id % 8 WHEN 0 THEN 'git commit -m x' WHEN 1 THEN 'git reset --hard head~1' WHEN 2 THEN 'git checkout -- a.py' WHEN 3 THEN 'git -c /p switch main' WHEN 4 THEN 'git reset --soft x' WHEN 5 THEN 'git stash pop' WHEN 6 THEN 'git -c k=v commit' ELSE 'npm run test' END), 12) AS print FROM events""")
def command_rules(spark, sf_dir):
    """A15, A16, A25."""
    commands = ("git commit -m x", "git  reset --hard HEAD~1", "git checkout -- a.py", "git -C /p switch main", "git reset --soft x", "git stash pop", "git -c k=v commit", "  npm run  test ")
    c = F.element_at(F.array(*map(F.lit, commands)), (F.col("event_id") % 8 + 1).cast("int"))
    return A.raw(spark, sf_dir, "events").select("event_id", X.git_kind(c).alias("kind"), X.is_test_command(c).alias("test"), X.command_fingerprint(c).alias("print"))
