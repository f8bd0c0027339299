"""Costs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave import adapters as A
from chronoweave.functions.messages import days_ago, message
from chronoweave.operators import chains as C
from chronoweave.operators import graph as G
from chronoweave.operators import reports as R
from chronoweave.operators.components import components

from .history import COMMIT
from .registry import query


def _samples(spark, sf_dir):
    li = A.raw(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_returnflag").alias("model"), F.col("l_extendedprice").cast("decimal(18,2)").alias("cost_usd"), F.col("l_quantity").cast("long").alias("input_tokens"), (F.col("l_quantity") * 2).cast("long").alias("output_tokens"))


def _sessions(spark, sf_dir):
    return A.raw(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("session_id"), (1 + F.col("o_custkey") % 3).alias("project_id"))


@query("SELECT l_returnflag AS model, count(*) AS samples, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_cost_usd, CAST(sum(l_quantity) AS BIGINT) AS total_input_tokens, CAST(sum(l_quantity * 2) AS BIGINT) AS total_output_tokens FROM lineitem GROUP BY 1")
def cost_by_model(spark, sf_dir):
    return R.cost_by_model(_samples(spark, sf_dir)).withColumn("total_cost_usd", F.col("total_cost_usd").cast("double"))


@query("""SELECT CASE WHEN o_orderstatus <> 'P' THEN 1 + o_custkey % 3 END AS project_id, count(*) AS samples, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def cost_session_bridge(spark, sf_dir):
    rows = R.bridged(_samples(spark, sf_dir), _sessions(spark, sf_dir))
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("cost_usd").cast("double").alias("cost"))


@query("""WITH c AS (SELECT 1 + o_custkey % 3 AS project_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_cost FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1),
m AS (SELECT project_id, max(seq) AS max_seq FROM det GROUP BY 1), s AS (SELECT project_id, count(*) AS stopped FROM inc WHERE signal = 'define_loop' AND state IN ('resolved', 'escalated_user') GROUP BY 1)
SELECT project_id, max_seq, total_cost, coalesce(stopped, 0) AS stopped, round(coalesce(stopped, 0) * 5 * total_cost / max_seq, 4) AS saved FROM m JOIN c USING (project_id) LEFT JOIN s USING (project_id)""")
def savings_tiers(spark, sf_dir):
    cost = R.bridged(_samples(spark, sf_dir), _sessions(spark, sf_dir)).where("project_id is not null").groupBy("project_id").agg(F.sum("cost_usd").cast("double").alias("total_cost"))
    rounds = A.determinations(spark, sf_dir).groupBy("project_id").agg(F.max("seq").alias("max_seq"))
    return R.savings(A.incidents(spark, sf_dir), cost, rounds).withColumn("saved", F.round("saved", 4))


@query("""WITH p(model, i, c, o) AS (VALUES ('ECONOMY', 3.0, 0.3, 15.0), ('STAND', 1.0, 0.1, 5.0), ('STANDARD', 2.0, 0.2, 9.0)),
t AS (SELECT DISTINCT p_type FROM part), b AS (SELECT p_type AS model, arg_max(p.model, length(p.model)) AS priced_as, arg_max(i, length(p.model)) AS i, arg_max(c, length(p.model)) AS c, arg_max(o, length(p.model)) AS o FROM t JOIN p ON starts_with(p_type, p.model) GROUP BY 1)
SELECT model, priced_as, CAST(round((i * 5000 + c * 1000 + o * 2000) / 1e6, 6) AS DOUBLE) AS round_cost FROM b""")
def list_prices(spark, sf_dir):
    price = spark.createDataFrame([("ECONOMY", 3.0, 0.3, 15.0), ("STAND", 1.0, 0.1, 5.0), ("STANDARD", 2.0, 0.2, 9.0)], "model string, input double, cache double, output double")
    rows = R.priced(A.raw(spark, sf_dir, "part").select(F.col("p_type").alias("model")).distinct(), price)
    return rows.select("model", "priced_as").join(R.round_cost(rows), "model").withColumn("round_cost", F.round("round_cost", 6))


@query("SELECT project_id, file_path, define_name, count(*) AS edits FROM det GROUP BY ALL ORDER BY edits DESC, project_id, file_path, define_name LIMIT 5")
def busiest_defines(spark, sf_dir):
    return R.busiest(A.determinations(spark, sf_dir))


@query("""WITH o AS (SELECT project_id, count(*) AS n, string_agg(DISTINCT signal, ',' ORDER BY signal) AS s FROM inc WHERE state <> 'resolved' GROUP BY 1)
SELECT project_id, count(DISTINCT file_path) AS files, count(DISTINCT (file_path, define_name)) AS defines, count(*) AS events, max(seq) AS max_seq, max(n) AS open_incidents, max(s) AS signals FROM det JOIN o USING (project_id) GROUP BY 1""")
def overview(spark, sf_dir):
    return R.overview(A.determinations(spark, sf_dir), A.incidents(spark, sf_dir))


@query("""WITH f AS (SELECT project_id, count(DISTINCT file_path) AS files, count(DISTINCT CASE WHEN user_id % 9 = 0 THEN file_path END) AS e FROM det GROUP BY 1), c AS (SELECT project_id, count(DISTINCT file_path) AS covered FROM cov GROUP BY 1)
SELECT project_id, files, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / (files - e), 6) AS share FROM f LEFT JOIN c USING (project_id)""")
def coverage_share(spark, sf_dir):
    det = A.determinations(spark, sf_dir)
    out = R.coverage_share(det, A.coverage(spark, sf_dir), det.where("user_id % 9 = 0"))
    return out.withColumn("share", F.round("share", 6))


@query("""WITH l AS (SELECT * FROM sess WHERE end_seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY start_seq DESC) = 1),
r AS (SELECT det.project_id, session_id, count(*) AS events, count(DISTINCT file_path) AS files, min(epoch_us(created_at)) AS a, max(epoch_us(created_at)) AS b FROM l JOIN det ON det.project_id = l.project_id AND seq > start_seq AND seq <= end_seq GROUP BY 1, 2)
SELECT r.project_id, session_id, events, files, (SELECT count(*) FROM inc WHERE inc.project_id = r.project_id AND created_us BETWEEN a AND b) AS incidents FROM r""")
def recap(spark, sf_dir):
    return R.recap(A.sessions(spark, sf_dir), A.determinations(spark, sf_dir), A.incidents(spark, sf_dir)).select("project_id", "session_id", "events", "files", "incidents")


@query("""WITH l AS (SELECT * FROM sess QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY start_seq DESC) <= 3), m AS (SELECT project_id, max(seq) AS top FROM det GROUP BY 1),
s AS (SELECT project_id, min(start_seq) AS low, max(coalesce(end_seq, top)) AS high FROM l JOIN m USING (project_id) GROUP BY 1)
SELECT s.project_id, low, high, count(*) AS changes, count(DISTINCT (file_path, define_name)) AS defines FROM s JOIN det ON det.project_id = s.project_id AND seq > low AND seq <= high GROUP BY ALL""")
def debug_range(spark, sf_dir):
    return R.debug_range(A.sessions(spark, sf_dir), A.determinations(spark, sf_dir))


@query("""SELECT signal, count(*) AS n, round_even(avg(CASE WHEN state = 'escalated_user' THEN 1.0 ELSE 0.0 END), 4) AS told, round_even(min(s), 1) AS least, round_even(quantile_cont(s, 0.25), 1) AS p25, round_even(quantile_cont(s, 0.5), 1) AS median, round_even(quantile_cont(s, 0.75), 1) AS p75, round_even(max(s), 1) AS most
FROM (SELECT *, CASE WHEN state = 'resolved' THEN (updated_us - created_us) / 1e6 END AS s FROM inc) GROUP BY 1""")
def calibration(spark, sf_dir):
    return R.calibration(A.incidents(spark, sf_dir))


@query("SELECT project_id, count(*) AS edits, count(DISTINCT (file_path, define_name)) AS defines, project_id > 1 AS no_tests, project_id <> 2 AS uncommitted FROM det GROUP BY 1")
def safety_net(spark, sf_dir):
    """Project 1 has runs; 2 was committed at its end, 1 long ago, 3 never."""
    det = A.determinations(spark, sf_dir)
    top = det.groupBy("project_id").agg(F.max("seq").alias("seq"))
    commits = top.where("project_id = 2").unionByName(top.where("project_id = 1").select("project_id", F.lit(10).cast("long").alias("seq")))
    return R.safety_net(det, A.test_runs(spark, sf_dir).select("project_id"), commits)


@query(f"""WITH ch AS (SELECT project_id, file_path, define_name, max(seq) AS ls FROM det WHERE seq > {COMMIT} GROUP BY ALL), rn AS (SELECT classname, name, max(run // 5) AS ran FROM cases GROUP BY ALL),
lt AS (SELECT ch.project_id, file_path || '::' || define_name AS target FROM ch JOIN cov USING (project_id, file_path, define_name) LEFT JOIN rn USING (classname, name) GROUP BY ALL HAVING bool_and(coalesce(ran < ls, true)))
SELECT project_id, 'run_tests' AS kind, min(target) AS target FROM lt GROUP BY 1 UNION ALL
SELECT project_id, 'blast_radius', file_path || '::' || define_name FROM (SELECT project_id, file_path, define_name, count(DISTINCT caller) AS c FROM ch JOIN hub ON callee = CAST(regexp_extract(file_path, '[0-9]+') AS BIGINT) WHERE project_id NOT IN (SELECT project_id FROM lt) GROUP BY ALL HAVING c >= 3)
 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY c DESC, file_path || '::' || define_name) = 1""")
def inline_assist(spark, sf_dir):
    """No project rests five events after its last change here, so run_tests or blast_radius come out."""
    det = A.determinations(spark, sf_dir)
    fan = G.fan_in(A.hub_calls(spark, sf_dir)).select(F.concat(F.lit("src/m"), "node", F.lit(".py")).alias("file_path"), "callers")
    callers = C.define_summary(det).select(*C.CHAIN).join(fan, "file_path")
    cov = A.coverage(spark, sf_dir).select("project_id", "file_path", "define_name", F.concat_ws("::", "classname", "name").alias("test_case"))
    ran = A.test_cases(spark, sf_dir).select(F.explode(F.array(*[F.lit(p).cast("long") for p in (1, 2, 3)])).alias("project_id"), F.concat_ws("::", "classname", "name").alias("test_case"), F.floor(F.col("test_run_id") / 5).cast("long").alias("seq"))
    return R.inline_assist(det, callers, cov, ran, COMMIT)


@query("""WITH u AS (SELECT f AS x, t AS y FROM forest UNION ALL SELECT t, f FROM forest), r AS (SELECT p_partkey AS node, p_partkey AS o FROM part UNION SELECT u.y, r.o FROM r JOIN u ON u.x = r.node), comp AS (SELECT node, min(o) AS c FROM r GROUP BY 1),
z AS (SELECT c, count(*) AS size FROM comp GROUP BY 1), pr AS (SELECT node, count(*) AS peers FROM (SELECT DISTINCT a.f AS node, b.f AS peer FROM gd a JOIN gd b ON a.t = b.t AND a.f <> b.f) GROUP BY 1)
SELECT node, (SELECT count(DISTINCT caller) FROM calls WHERE callee = node) AS callers, (SELECT count(DISTINCT callee) FROM calls WHERE caller = node) AS callees, coalesce(peers, 0) AS peers, size AS component_size
FROM comp JOIN z USING (c) LEFT JOIN pr USING (node)""")
def briefing(spark, sf_dir):
    nodes = A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    parts = components(A.gd_forest(spark, sf_dir), "from_det", "to_det", nodes)
    return R.briefing(nodes, A.calls(spark, sf_dir), A.gd_edges(spark, sf_dir), parts)


@query("""SELECT id, 'define_loop' = signal AS is_loop, contains(target_node, '::') AS named, CASE date_diff('day', CAST(make_timestamp(created_us) AS DATE), DATE '2024-01-30') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday'
ELSE CASE WHEN date_diff('day', CAST(make_timestamp(created_us) AS DATE), DATE '2024-01-30') <= 7 THEN date_diff('day', CAST(make_timestamp(created_us) AS DATE), DATE '2024-01-30') || ' days ago' ELSE strftime(make_timestamp(created_us), '%Y-%m-%d') END END AS day FROM inc""")
def drift_messages(spark, sf_dir):
    """Messages of incidents; the texts are ours, so SQL checks that they hold the target and fit the signal."""
    rows = A.incidents(spark, sf_dir)
    text = message(F.col("signal"), F.col("target_node"), F.lit("agent"))
    day = F.timestamp_micros("created_us").cast("date")
    return rows.select("id", text.contains("back at a form").alias("is_loop"), F.contains(text, F.col("target_node")).alias("named"), days_ago(day, F.lit("2024-01-30").cast("date")).alias("day"))


@query("SELECT project_id, 'c' || n AS commit_hash, max(seq) AS snapshot_at_seq FROM (SELECT project_id, seq, 1 + (seq - 1) * 10 // max(seq) OVER (PARTITION BY project_id) AS n FROM det) GROUP BY 1, n QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY max(seq) DESC) <= 4")
def list_snapshots(spark, sf_dir):
    """Of ten snapshots of each project the newest four."""
    det = A.determinations(spark, sf_dir)
    top = det.groupBy("project_id").agg(F.max("seq").alias("top"))
    part = 1 + F.floor((F.col("seq") - 1) * 10 / F.col("top"))
    marks = det.join(top, "project_id").groupBy("project_id", part.alias("n")).agg(F.max("seq").alias("snapshot_at_seq"))
    from chronoweave.operators.ranks import top_rows

    newest = top_rows(marks, ["project_id"], [F.desc("snapshot_at_seq")], 4)
    return newest.select("project_id", F.concat(F.lit("c"), "n").alias("commit_hash"), "snapshot_at_seq")
