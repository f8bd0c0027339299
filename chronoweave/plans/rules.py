"""Detectors, the state machine of incidents, and the upkeep of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave import adapters as A
from chronoweave.operators import chains as C
from chronoweave.operators import detectors as D
from chronoweave.operators import escalation as E
from chronoweave.operators import intervals as I
from chronoweave.operators import maintenance as M
from chronoweave.operators import outcomes as O
from chronoweave.scratch import stored
from chronoweave.sources.files import outside

from .history import COMMIT, KEY, _history
from .registry import query

_STUCK = f"st AS (SELECT {KEY}, file_path || '::' || define_name AS target, count(*) AS n FROM det GROUP BY ALL HAVING count(*) >= {C.STUCK_LENGTH} AND count(node_fingerprint) = count(DISTINCT node_fingerprint))"
_FAILING = """fl AS (SELECT file_path, define_name FROM (SELECT file_path, define_name, min(id) AS a, max(id) AS b FROM det GROUP BY ALL) s JOIN cov USING (file_path, define_name) JOIN cases USING (classname, name)
WHERE run BETWEEN a AND b AND status <> 'skipped' GROUP BY ALL HAVING bool_and(status = 'failed'))"""
_DEBUG = f"{_STUCK}, {_FAILING}, db AS (SELECT project_id, target FROM st JOIN fl USING (file_path, define_name))"


def _debug(spark, sf_dir, det, stuck):
    one = F.lit(1).cast("long").alias("project_id")
    spans = det.groupBy("file_path", "define_name").agg(F.min("id").alias("first_seq"), F.max("id").alias("last_seq"))
    spans = spans.select(F.concat_ws("::", "file_path", "define_name").alias("define_key"), one, "first_seq", "last_seq")
    cov = A.coverage(spark, sf_dir).select(F.concat_ws("::", "file_path", "define_name").alias("define_key"), "classname", "name")
    failing = O.persistent_failure(_history(spark, sf_dir).where("status <> 'skipped'"), cov, spans).where("failing")
    keys = failing.select(F.substring_index("define_key", "::", 1).alias("file_path"), F.substring_index("define_key", "::", -1).alias("define_name"))
    return D.debug_loop(stuck, keys.join(det.select(*C.CHAIN).distinct(), ["file_path", "define_name"]))


@query(f"WITH {_DEBUG} SELECT project_id, 'debug_loop' AS signal, target AS target_node FROM db")
def sig_debug_loop(spark, sf_dir):
    det = stored(A.determinations(spark, sf_dir))
    return _debug(spark, sf_dir, det, C.stuck(det))


@query(f"WITH {_DEBUG} SELECT project_id, 'stuck_region' AS signal, target AS target_node FROM st WHERE (project_id, target) NOT IN (SELECT project_id, target FROM db)")
def sig_stuck(spark, sf_dir):
    det = stored(A.determinations(spark, sf_dir))
    stuck = stored(C.stuck(det))
    return D.stuck_region(stuck, _debug(spark, sf_dir, det, stuck))


@query("""SELECT project_id, 'token_waste' AS signal, file_path || '::' || define_name AS target_node, version_count AS rounds FROM chains
WHERE version_count >= 15 AND (project_id, file_path || '::' || define_name) IN (SELECT project_id, target_node FROM inc WHERE state <> 'resolved' AND signal <> 'define_loop')
AND (project_id, file_path || '::' || define_name) IN (SELECT project_id, target_node FROM inc WHERE signal <> 'define_loop' GROUP BY ALL HAVING count(*) >= 2)""")
def sig_waste(spark, sf_dir):
    inc = A.incidents(spark, sf_dir)
    return D.token_waste(C.define_summary(A.determinations(spark, sf_dir)), inc.where("state <> 'resolved'"), inc)


_LOOP = f"""x AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq) AS i FROM det),
lp AS (SELECT DISTINCT b.project_id, b.file_path, b.define_name FROM x a JOIN x b USING (project_id, file_path, define_name, node_fingerprint, fine_fingerprint) WHERE b.i - a.i >= 2)"""


@query(f"WITH {_LOOP} SELECT project_id, 'define_loop' AS signal, file_path || '::' || define_name AS target_node, 'return' AS mechanism, false AS direct FROM lp")
def sig_define_loop(spark, sf_dir):
    """No project's last events are five in a row on one define here, so returns are all there is."""
    det = stored(A.determinations(spark, sf_dir))
    evolution = I.error_evolution(I.round_signatures(det, A.crashes(spark, sf_dir, det), C.CHAIN), C.CHAIN)
    stuck = stored(C.stuck(det))
    return D.define_loop(det, evolution, stuck, _debug(spark, sf_dir, det, stuck))


@query("SELECT DISTINCT 1 + user_id % 3 AS project_id, 'boundary_breach' AS signal, 'w/' || user_id || '/a.py' AS target_node FROM events WHERE user_id NOT IN (1, 12)")
def sig_boundary(spark, sf_dir):
    paths = A.raw(spark, sf_dir, "events").select((1 + F.col("user_id") % 3).alias("project_id"), F.concat(F.lit("w/"), "user_id", F.lit("/a.py")).alias("path"))
    return D.boundary_breach(outside(paths, ["w/1", "w/12"]))


@query("""SELECT DISTINCT project_id, 'task_scope_breach' AS signal, file_path AS target_node, CASE WHEN file_path LIKE '%5.py' THEN 'forbidden' ELSE 'not_allowed' END AS kind FROM det
WHERE seq > 2000 AND (file_path LIKE '%5.py' OR NOT (file_path LIKE 'src/m1%.py' OR regexp_matches(file_path, '^src/m[3-4].[.]py$')))""")
def sig_scope(spark, sf_dir):
    changed = A.determinations(spark, sf_dir).where("seq > 2000").select("project_id", "file_path")
    return D.task_scope_breach(changed, ["src/m1*.py", "src/m[3-4]?.py"], ["*5.py"])


@query(f"""WITH g AS (SELECT classname, name FROM (SELECT classname, name, arg_max(status, run) AS st, max(run) AS lr, min(CASE WHEN status = 'passed' THEN run END) AS fp FROM cases GROUP BY ALL) WHERE st = 'failed' AND fp < lr)
SELECT DISTINCT project_id, 'regression' AS signal, classname || '::' || name AS target_node FROM g JOIN cov USING (classname, name) WHERE (project_id, file_path, define_name) IN (SELECT {KEY} FROM det WHERE seq > {COMMIT})""")
def sig_regression(spark, sf_dir):
    association = A.coverage(spark, sf_dir).select(F.concat_ws("::", "file_path", "define_name").alias("define_key"), "classname", "name")
    changed = C.changed_since(A.determinations(spark, sf_dir), COMMIT)
    return D.regression(O.green_to_red(_history(spark, sf_dir)), association, changed)


@query("""WITH e AS (SELECT classname, name, CAST(replace(classname, 'tests.C', '') AS BIGINT) AS c, arg_max(status, run) AS st, max(run) AS lr, min(CASE WHEN status = 'failed' THEN run END) AS ff, max(CASE WHEN status = 'failed' THEN run END) AS lf FROM cases GROUP BY ALL)
SELECT CAST(1 AS BIGINT) AS project_id, 'test_tampering' AS signal, classname || '::' || name AS target_node FROM e WHERE st = 'passed' AND ff < lr AND c % 3 = 0
AND NOT EXISTS (SELECT 1 FROM det WHERE user_id = c AND id > lf AND id <= lr)""")
def sig_tampering(spark, sf_dir):
    green = O.last_red(_history(spark, sf_dir)).withColumn("c", F.regexp_replace("classname", "tests.C", "").cast("long"))
    edited = green.where("c % 3 = 0").select("classname", "name")
    windows = green.select("classname", "name", F.col("c").alias("user_id"), F.col("red_seq").alias("low"), F.col("green_seq").alias("high"))
    events = A.determinations(spark, sf_dir).select("user_id", F.col("id").alias("at"))
    changes = I.within(events, windows, ["user_id"], "at", "low", "high").select("classname", "name", F.lit(True).alias("explains")).distinct()
    return D.test_tampering(green, edited, changes)


@query("""SELECT project_id, 'dangling_reference' AS signal, file_path || '::' || define_name || '::f' || k % 5 AS target_node, count(DISTINCT id) AS seen FROM det WHERE k < 10 GROUP BY project_id, file_path, define_name, k % 5 HAVING count(DISTINCT id) >= 2""")
def sig_dangling(spark, sf_dir):
    seen = A.determinations(spark, sf_dir).where("k < 10").select("project_id", "file_path", F.col("define_name").alias("caller_define"), F.concat(F.lit("f"), F.col("k") % 5).alias("callee_text"), F.col("id").alias("det_id"))
    return D.dangling_reference(seen)


@query("""WITH bad AS (SELECT DISTINCT project_id, file_path FROM det WHERE seq > 3000 AND k % 2 = 0)
SELECT project_id, 'parse_skipped' AS signal, file_path AS target_node FROM bad WHERE file_path NOT LIKE '%1.py'""")
def sig_parse_skipped(spark, sf_dir):
    failed = A.determinations(spark, sf_dir).where("seq > 3000 and k % 2 = 0").select("project_id", "file_path", F.lit(False).alias("ok"))
    known = failed.where("file_path like '%1.py'").select("project_id", F.lit("parse_skipped").alias("signal"), F.col("file_path").alias("target_node"), F.lit("open").alias("state"))
    return D.parse_skipped(failed, known)[0]


_LATERAL = """tg AS (SELECT p_partkey AS node FROM part), mv AS (SELECT p_partkey AS n FROM part WHERE p_size > 10 AND p_size <= 30),
cl AS (SELECT caller AS node, count(DISTINCT callee) AS x FROM calls JOIN mv ON n = callee GROUP BY 1), pr AS (SELECT DISTINCT a.f AS node, b.f AS peer FROM gd a JOIN gd b ON a.t = b.t AND a.f <> b.f),
ps AS (SELECT node, count(*) AS y, count(n) AS z FROM pr LEFT JOIN mv ON n = peer GROUP BY 1),
lc AS (SELECT node, coalesce(x, 0) AS callees_changed, coalesce(y, 0) AS peers, coalesce(z, 0) AS peers_changed FROM tg LEFT JOIN cl USING (node) LEFT JOIN ps USING (node))"""


def _lateral(spark, sf_dir):
    p = A.raw(spark, sf_dir, "part")
    targets = p.select(F.col("p_partkey").alias("node"))
    moved = p.select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("seq"))
    return D.lateral_context(targets, A.calls(spark, sf_dir), A.gd_edges(spark, sf_dir), moved, 10, 30)


@query(f"WITH {_LATERAL} SELECT node, callees_changed, peers, peers_changed FROM lc")
def lateral_context(spark, sf_dir):
    return _lateral(spark, sf_dir)


@query(f"""WITH {_LATERAL} SELECT node, CASE WHEN node % 200 = 0 AND callees_changed > 0 THEN 1 WHEN node % 200 = 0 THEN 2 WHEN callees_changed > 0 THEN 3 WHEN peers_changed > 0 THEN 4 WHEN peers > 0 THEN 5 ELSE 6 END AS place FROM lc""")
def direction_note(spark, sf_dir):
    rows = D.direction_note(_lateral(spark, sf_dir).withColumn("failing", F.col("node") % 200 == 0))
    order = ["tests fail and callees changed%", "tests fail through%", "callees changed%", "defines with the same%", "others serve%"]
    place = F.lit(6)
    for i, text in reversed(list(enumerate(order, 1))):
        place = F.when(F.col("note").like(text), i).otherwise(place)
    return rows.select("node", place.cast("int").alias("place"))


@query("""WITH r0 AS (SELECT user_id AS incident, ['stuck_region', 'test_tampering', 'regression', 'define_loop'][user_id % 4 + 1] AS signal, ['high', 'medium', 'low', 'silent'][user_id // 4 % 4 + 1] AS level, user_id % 5 = 0 AS direct,
 event_type IN ('error', 'view', 'click') AS rec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r1 AS (SELECT *, CASE WHEN signal = 'test_tampering' THEN 1 WHEN signal = 'stuck_region' THEN 3 ELSE 2 END AS th FROM r0),
r AS (SELECT *, CASE WHEN level = 'high' THEN greatest(1, th - 1) WHEN signal = 'test_tampering' THEN th WHEN level = 'medium' THEN th WHEN level = 'low' THEN th + 2 END AS eff,
 CASE WHEN level = 'silent' AND signal <> 'test_tampering' THEN NULL ELSE 1 END AS eff1, count(*) OVER (PARTITION BY incident) AS total FROM r1),
f(incident, n, state, cnt, stable, agent, usr) AS (SELECT DISTINCT incident, 0, 'open', 0, 0, 0, 0 FROM r
 UNION ALL SELECT f.incident, f.n + 1,
  CASE WHEN state = 'open' THEN (CASE WHEN direct AND eff1 IS NOT NULL THEN 'escalated_user' ELSE 'notified_agent' END)
   WHEN state = 'notified_agent' AND rec AND eff IS NOT NULL AND cnt + 1 >= eff THEN 'escalated_user'
   WHEN state IN ('notified_agent', 'escalated_user') AND NOT rec AND (signal = 'test_tampering' OR stable + 1 >= 2) THEN 'resolved' ELSE state END,
  CASE WHEN state = 'notified_agent' AND rec THEN cnt + 1 ELSE cnt END,
  CASE WHEN state IN ('notified_agent', 'escalated_user') THEN (CASE WHEN rec THEN 0 WHEN signal = 'test_tampering' THEN stable ELSE stable + 1 END) ELSE stable END,
  agent + CASE WHEN (state = 'open' AND NOT (direct AND eff1 IS NOT NULL)) OR (state = 'notified_agent' AND rec AND (eff IS NULL OR cnt + 1 < eff)) THEN 1 ELSE 0 END,
  usr + CASE WHEN (state = 'open' AND direct AND eff1 IS NOT NULL) OR (state = 'notified_agent' AND rec AND eff IS NOT NULL AND cnt + 1 >= eff) THEN 1 ELSE 0 END
  FROM f JOIN r ON r.incident = f.incident AND r.n = f.n + 1)
SELECT f.incident, signal, level, direct, total AS rounds, state, CAST(cnt AS BIGINT) AS count, CAST(stable AS BIGINT) AS stable, CAST(agent AS BIGINT) AS agent, CAST(usr AS BIGINT) AS "user"
FROM f JOIN r ON r.incident = f.incident AND r.n = f.n AND r.total = f.n""")
def incident_fsm(spark, sf_dir):
    """2.K: one incident for each user, its events as rounds, in which errors, views and clicks are recurrences."""
    e, u = A.raw(spark, sf_dir, "events"), F.col("user_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % 4 + 1).cast("int"))
    signal = pick(("stuck_region", "test_tampering", "regression", "define_loop"), u)
    level = pick(("high", "medium", "low", "silent"), F.floor(u / 4))
    rounds = e.select(u.alias("incident"), signal.alias("signal"), level.alias("level"), (u % 5 == 0).alias("direct"), F.col("event_id").alias("round"), F.col("event_type").isin("error", "view", "click").alias("recurred"))
    return E.fold(rounds, ["incident"])


@query("SELECT signal, state, count(*) AS n FROM inc GROUP BY ALL")
def incident_histogram(spark, sf_dir):
    return A.incidents(spark, sf_dir).groupBy("signal", "state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT signal, quantile_cont((updated_us - created_us) / 1e6, 0.5) AS seconds FROM inc WHERE state = 'resolved' GROUP BY 1")
def resolve_median(spark, sf_dir):
    rows = A.incidents(spark, sf_dir).where("state = 'resolved'")
    return rows.groupBy("signal").agg(F.percentile((F.col("updated_us") - F.col("created_us")) / 1e6, 0.5).alias("seconds"))


# upkeep


@query(f"""WITH l AS (SELECT {KEY}, content_hash, edit_type FROM det WHERE seq <= 1500 QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) = 1),
n AS (SELECT {KEY}, content_hash FROM det WHERE user_id % 10 > 0 QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) = 1 AND edit_type <> 'delete')
SELECT coalesce(l.project_id, n.project_id) AS project_id, coalesce(l.file_path, n.file_path) AS file_path, coalesce(l.define_name, n.define_name) AS define_name, n.content_hash,
CASE WHEN n.content_hash IS NULL THEN 'delete' WHEN l.edit_type IS NULL OR l.edit_type = 'delete' THEN 'create' ELSE 'modify' END AS edit_type
FROM l FULL JOIN n ON l.project_id = n.project_id AND l.file_path = n.file_path AND l.define_name = n.define_name
WHERE CASE WHEN n.content_hash IS NULL THEN l.edit_type <> 'delete' WHEN l.edit_type IS NULL OR l.edit_type = 'delete' THEN true ELSE l.content_hash <> n.content_hash END""")
def cdc_diff(spark, sf_dir):
    det = A.determinations(spark, sf_dir)
    now = C.as_of(det.where("user_id % 10 > 0"), 1 << 60)
    return M.capture(det.where("seq <= 1500"), now)


@query("""WITH e AS (SELECT DISTINCT 1 + user_id % 3 AS project_id, file_path, define_name FROM det WHERE seq > 3200)
SELECT e.project_id, file_path, define_name, 3200 + row_number() OVER (PARTITION BY e.project_id ORDER BY file_path, define_name) AS seq FROM (SELECT DISTINCT project_id, file_path, define_name FROM det WHERE seq > 3200) e""")
def seq_allocation(spark, sf_dir):
    det = A.determinations(spark, sf_dir)
    new = det.where("seq > 3200").select(*C.CHAIN).distinct()
    return M.numbered(new, det.where("seq <= 3200"), ["file_path", "define_name"]).select(*C.CHAIN, "seq")


@query("SELECT l_partkey AS caller, l_suppkey AS callee, min(CASE WHEN l_orderkey % 2 = 0 THEN 'call' ELSE 'import' END) AS edge_kind, count(*) AS n FROM lineitem GROUP BY 1, 2")
def upsert_latest(spark, sf_dir):
    """Of edges between the same two a call wins; the count shows that the key is unique afterwards."""
    li = A.raw(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_orderkey") % 2 == 0, "call").otherwise("import")
    rows = li.select(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"), kind.alias("edge_kind"), F.when(kind == "call", 1).otherwise(0).alias("v"))
    counts = rows.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n"))
    half = F.col("caller") % 2 == 0
    return M.upserted(rows.where(half), rows.where(~half), ["caller", "callee"], "v").drop("v").join(counts, ["caller", "callee"])


@query("SELECT classname, run FROM (SELECT classname, run, row_number() OVER (PARTITION BY 1 ORDER BY run DESC) AS rn FROM cases) WHERE rn <= 1000 UNION ALL SELECT classname, run FROM (SELECT classname, run, row_number() OVER (PARTITION BY classname ORDER BY run DESC) AS rn FROM cases) WHERE rn <= 2")
def retention_keep_k(spark, sf_dir):
    """The newest 1,000 runs of the project, and the newest two of each class."""
    cases = A.test_cases(spark, sf_dir).select("classname", F.col("test_run_id").alias("run")).withColumn("project_id", F.lit(1))
    return M.kept(cases, ["project_id"], "run", 1000).select("classname", "run").unionByName(M.kept(cases, ["classname"], "run", 2).select("classname", "run"))


@query(f"SELECT project_id, fine_fingerprint AS class_key, count(*) AS members, min(file_path || '::' || define_name) AS least FROM (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) = 1) WHERE edit_type <> 'delete' GROUP BY 1, 2")
def equivalence_classes(spark, sf_dir):
    return M.equivalence_classes(A.determinations(spark, sf_dir), F.concat_ws("::", "file_path", "define_name"))


@query("SELECT event_id FROM (SELECT event_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS b FROM events) WHERE b IS NULL OR u - b > 7200000000")
def dedup_window(spark, sf_dir):
    return M.not_repeated(A.raw(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 7200).select("event_id")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY")
def recent_events(spark, sf_dir):
    return M.recent(A.raw(spark, sf_dir, "events"), "ts", "2024-01-30 12:00:00", 86_400).select("event_id")


@query("SELECT id, CASE WHEN signal = 'define_loop' AND state = 'open' THEN 'taken' ELSE 'left' END AS what FROM inc")
def queue_take(spark, sf_dir):
    queue = A.incidents(spark, sf_dir).select("id", F.when(F.col("signal") == "define_loop", "user").otherwise("agent").alias("channel"), F.when(F.col("state") != "open", F.col("updated_us")).alias("taken_at"))
    out, left = M.taken(queue, "user")
    return out.select("id", F.lit("taken").alias("what")).unionByName(left.select("id", F.lit("left").alias("what")))


@query("SELECT project_id, file_path, CASE WHEN bool_or(seq > 2500) OR bool_or(k % 3 = 0 AND seq <= 2500) THEN 'pending' ELSE 'done' END AS status FROM det GROUP BY 1, 2")
def recompute_queue(spark, sf_dir):
    det = A.determinations(spark, sf_dir)
    queue = det.where("seq <= 2500").groupBy("project_id", "file_path").agg(F.max(F.when(F.col("k") % 3 == 0, "pending").otherwise("done")).alias("status"))
    return M.queued(queue, det.where("seq > 2500").select("project_id", "file_path").distinct())


@query("SELECT state, count(*) AS n, CAST(count(*) FILTER (WHERE state IN ('open', 'notified_agent', 'escalated_user', 'resolved')) AS BIGINT) AS allowed FROM (SELECT CASE WHEN id % 7 = 0 THEN 'lost' ELSE state END AS state FROM inc) GROUP BY 1")
def enum_quarantine(spark, sf_dir):
    rows = A.incidents(spark, sf_dir).withColumn("state", F.when(F.col("id") % 7 == 0, "lost").otherwise(F.col("state")))
    good, bad = M.checked(rows, "state")
    marked = good.withColumn("ok", F.lit(1)).unionByName(bad.withColumn("ok", F.lit(0)))
    return marked.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").cast("long").alias("allowed"))
