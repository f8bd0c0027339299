"""Chains, outcomes, intervals: queries over the order of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave import adapters as A
from chronoweave.functions.idents import is_test_file
from chronoweave.operators import chains as C
from chronoweave.operators import graph as G
from chronoweave.operators import intervals as I
from chronoweave.operators import outcomes as O

from .registry import query

KEY = "project_id, file_path, define_name"
#: Two points of the order that the snapshot queries compare, and the point of the last commit.
EARLY, LATE, COMMIT = 200, 1200, 2000

_STATE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM det WHERE seq <= %d) WHERE rn = 1 AND edit_type <> 'delete'"


@query(f"""WITH a AS ({_STATE % EARLY}), b AS ({_STATE % LATE})
SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.define_name, b.define_name) AS define_name,
a.content_hash AS before_hash, b.content_hash AS after_hash, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.project_id = b.project_id AND a.file_path = b.file_path AND a.define_name = b.define_name WHERE a.content_hash IS DISTINCT FROM b.content_hash""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.snapshot_diff(A.determinations(spark, sf_dir), EARLY, LATE)


@query(f"SELECT {KEY}, seq, row_number() OVER (PARTITION BY {KEY} ORDER BY seq) AS version, edit_type FROM det")
def version_chain(spark, sf_dir):
    return C.version_chain(A.determinations(spark, sf_dir)).select(*C.CHAIN, "seq", "version", "edit_type")


@query(f"SELECT {KEY}, id, seq, edit_type, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS rn FROM det) WHERE rn = 1")
def current_version(spark, sf_dir):
    return C.current_version(A.determinations(spark, sf_dir)).select(*C.CHAIN, "id", "seq", "edit_type", "content_hash")


@query(f"SELECT {KEY}, seq, content_hash FROM ({_STATE % EARLY})")
def live_asof_seq(spark, sf_dir):
    return C.as_of(A.determinations(spark, sf_dir), EARLY).select(*C.CHAIN, "seq", "content_hash")


@query("SELECT * FROM chains")
def define_summary(spark, sf_dir):
    return C.define_summary(A.determinations(spark, sf_dir))


@query(f"SELECT {KEY}, max(seq) AS last_seq FROM det WHERE seq > {COMMIT} GROUP BY ALL")
def changed_since(spark, sf_dir):
    return C.changed_since(A.determinations(spark, sf_dir), COMMIT)


@query(f"SELECT {KEY}, count(node_fingerprint) AS n, count(DISTINCT node_fingerprint) AS different, count(node_fingerprint) = count(DISTINCT node_fingerprint) AS all_distinct FROM det GROUP BY ALL")
def distinct_fp_check(spark, sf_dir):
    return C.distinct_fingerprints(A.determinations(spark, sf_dir))


_LOOPS = f"""x AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq) - 1 AS idx FROM det),
l AS (SELECT b.project_id, b.file_path, b.define_name, b.seq, b.idx, b.node_fingerprint, min(a.idx) AS fi, min(a.seq) AS fs FROM x b JOIN x a
ON a.project_id = b.project_id AND a.file_path = b.file_path AND a.define_name = b.define_name AND a.node_fingerprint = b.node_fingerprint AND a.fine_fingerprint = b.fine_fingerprint AND a.idx <= b.idx GROUP BY ALL)"""


@query(f"WITH {_LOOPS} SELECT {KEY}, arg_min(fs, idx) AS earlier_seq, arg_min(seq, idx) AS later_seq, arg_min(node_fingerprint, idx) AS fingerprint FROM l WHERE idx - fi >= 2 GROUP BY ALL")
def loop_back(spark, sf_dir):
    return C.loop_back(A.determinations(spark, sf_dir))


@query(f"WITH {_LOOPS} SELECT {KEY}, seq, node_fingerprint FROM l QUALIFY idx = max(idx) OVER (PARTITION BY {KEY}) AND idx - fi >= 2")
def latest_loop(spark, sf_dir):
    return C.latest_loops(A.determinations(spark, sf_dir))


@query("""WITH h AS (SELECT project_id, arg_max(file_path, seq) AS hf, arg_max(define_name, seq) AS hd FROM det GROUP BY 1),
o AS (SELECT det.project_id, max(CASE WHEN file_path <> hf OR define_name <> hd THEN seq END) AS os FROM det JOIN h USING (project_id) GROUP BY 1)
SELECT det.project_id, hf AS file_path, hd AS define_name, count(*) AS streak FROM det JOIN h USING (project_id) JOIN o USING (project_id) WHERE seq > coalesce(os, -1) GROUP BY ALL""")
def head_streak(spark, sf_dir):
    return C.head_streak(A.determinations(spark, sf_dir))


@query(f"SELECT {KEY}, lag(id) OVER w AS from_id, id AS to_id, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS back FROM det WINDOW w AS (PARTITION BY {KEY} ORDER BY seq) QUALIFY from_id IS NOT NULL")
def adjacent_dj(spark, sf_dir):
    return C.adjacent_pairs(A.determinations(spark, sf_dir))


@query(f"SELECT {KEY}, count(*) AS version_count FROM det GROUP BY ALL HAVING count(*) >= 5 AND count(node_fingerprint) = count(DISTINCT node_fingerprint)")
def stuck_candidates(spark, sf_dir):
    return C.stuck(A.determinations(spark, sf_dir))


@query(f"SELECT {KEY}, round_even((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 / 3600, 1) AS hours FROM det GROUP BY ALL")
def edit_span_hours(spark, sf_dir):
    return C.edit_span(A.determinations(spark, sf_dir))


@query(f"""SELECT project_id, max(max_seq) AS max_seq, max(seq) AS cluster_seq, max(max_seq) - max(seq) >= 5 AS stable
FROM det JOIN (SELECT project_id, max(seq) AS max_seq FROM det GROUP BY 1) USING (project_id) WHERE seq > {COMMIT} AND user_id >= 15 GROUP BY 1""")
def cluster_stability(spark, sf_dir):
    det = A.determinations(spark, sf_dir)
    return C.cluster_stability(det, COMMIT, det.where("user_id < 15").select("project_id", "file_path").distinct()).select("project_id", "max_seq", "cluster_seq", "stable")


def _history(spark, sf_dir):
    return O.case_history(A.test_cases(spark, sf_dir), A.test_runs(spark, sf_dir))


_ENDS = """e AS (SELECT classname, name, arg_max(status, run) AS st, max(run) AS lr, count(*) AS results, min(CASE WHEN status = 'passed' THEN run END) AS fp,
min(CASE WHEN status IN ('failed', 'error') THEN run END) AS ff, max(CASE WHEN status IN ('failed', 'error') THEN run END) AS lf FROM cases GROUP BY ALL)"""


@query("SELECT classname, name, run AS test_run_id, status, row_number() OVER (PARTITION BY classname, name ORDER BY run) AS place FROM cases")
def case_history(spark, sf_dir):
    return _history(spark, sf_dir).select("classname", "name", "test_run_id", "status", "place")


@query(f"WITH {_ENDS} SELECT classname, name, results FROM e WHERE st IN ('failed', 'error') AND fp < lr")
def green_to_red(spark, sf_dir):
    return O.green_to_red(_history(spark, sf_dir)).drop("project_id")


@query(f"WITH {_ENDS} SELECT classname, name, results FROM e WHERE st = 'passed' AND ff < lr")
def red_to_green(spark, sf_dir):
    return O.red_to_green(_history(spark, sf_dir)).drop("project_id")


@query(f"WITH {_ENDS} SELECT classname, name, lf AS red_run, lf AS red_seq, lr AS green_seq FROM e WHERE st = 'passed' AND ff < lr")
def last_red_before_green(spark, sf_dir):
    return O.last_red(_history(spark, sf_dir)).drop("project_id")


@query("""WITH s AS (SELECT file_path, define_name, min(id) AS a, max(id) AS b FROM det GROUP BY ALL)
SELECT s.file_path || '::' || s.define_name AS define_key, bool_and(status IN ('failed', 'error')) AS failing, count(*) AS results
FROM s JOIN cov USING (file_path, define_name) JOIN cases USING (classname, name) WHERE run BETWEEN a AND b GROUP BY 1""")
def persistent_failure(spark, sf_dir):
    det, one = A.determinations(spark, sf_dir), F.lit(1).cast("long").alias("project_id")
    key = F.concat_ws("::", "file_path", "define_name").alias("define_key")
    spans = det.groupBy(key).agg(F.min("id").alias("first_seq"), F.max("id").alias("last_seq")).withColumn("project_id", one)
    return O.persistent_failure(_history(spark, sf_dir), A.coverage(spark, sf_dir).select(key, "classname", "name"), spans)


@query("""WITH w AS (SELECT classname || '::' || name AS window_id, 1 + CAST(replace(classname, 'tests.C', '') AS BIGINT) % 3 AS project_id, min(run) AS low, min(run) + 150 AS high FROM cases GROUP BY classname, name)
SELECT DISTINCT window_id, w.project_id, file_path, define_name FROM w JOIN det ON det.project_id = w.project_id AND seq > low AND seq <= high WHERE file_path NOT LIKE '%7.py'""")
def prod_changes_in_window(spark, sf_dir):
    windows = A.test_cases(spark, sf_dir).groupBy("classname", "name").agg(F.min("test_run_id").alias("low"))
    windows = windows.select(F.concat_ws("::", "classname", "name").alias("window_id"), (1 + F.regexp_replace("classname", "tests.C", "").cast("long") % 3).alias("project_id"), "low", (F.col("low") + 150).alias("high"))
    return O.production_changes(windows, A.determinations(spark, sf_dir), F.col("file_path").endswith("7.py") | is_test_file(F.col("file_path")))


def _coverage(spark, sf_dir):
    return A.coverage(spark, sf_dir).select("project_id", "file_path", "define_name", F.concat_ws("::", "classname", "name").alias("test_case"))


@query("""WITH ran AS (SELECT classname, name, max(run) AS ran FROM cases GROUP BY ALL)
SELECT project_id, file_path, define_name, count(*) AS cases FROM chains JOIN cov USING (project_id, file_path, define_name) LEFT JOIN ran USING (classname, name)
GROUP BY ALL HAVING bool_and(coalesce(ran < latest_seq + 9000, true))""")
def stale_covered(spark, sf_dir):
    summary = C.define_summary(A.determinations(spark, sf_dir)).withColumn("latest_seq", F.col("latest_seq") + 9000)
    cov = _coverage(spark, sf_dir).withColumn("define_name", F.concat_ws("::", "file_path", "define_name")).drop("file_path")
    history = _history(spark, sf_dir)
    projects = F.explode(F.array(*[F.lit(p).cast("long") for p in (1, 2, 3)]))
    out = O.stale_covered(summary.withColumn("define_name", F.concat_ws("::", "file_path", "define_name")), cov, history.withColumn("project_id", projects))
    return out.withColumn("define_name", F.substring_index("define_name", "::", -1))


@query("""WITH c AS (SELECT callee, count(DISTINCT caller) AS n FROM hub GROUP BY 1)
SELECT project_id, file_path, define_name, coalesce(n, 0) AS callers, version_count FROM chains LEFT JOIN c ON c.callee = CAST(regexp_extract(file_path, '[0-9]+') AS BIGINT)
WHERE (project_id, define_name) NOT IN (SELECT project_id, define_name FROM cov) ORDER BY callers DESC, version_count DESC, project_id, file_path, define_name LIMIT 20""")
def uncovered_ranked(spark, sf_dir):
    """the report shows the first 20."""
    summary = C.define_summary(A.determinations(spark, sf_dir))
    fan = G.fan_in(A.hub_calls(spark, sf_dir)).select(F.concat(F.lit("src/m"), "node", F.lit(".py")).alias("file_path"), "callers")
    callers = summary.select(*C.CHAIN).join(fan, "file_path")
    return O.uncovered_ranked(summary, _coverage(spark, sf_dir), callers).orderBy(F.desc("callers"), F.desc("version_count"), *C.CHAIN).limit(20)


@query("SELECT sess.project_id, session_id, count(*) AS changes, count(DISTINCT file_path) AS files FROM sess JOIN det ON det.project_id = sess.project_id AND seq > start_seq AND seq <= coalesce(end_seq, 1000000000) GROUP BY ALL")
def session_changes(spark, sf_dir):
    rows = I.within(A.determinations(spark, sf_dir), A.sessions(spark, sf_dir), ["project_id"], "seq", "start_seq", "end_seq")
    return rows.groupBy("project_id", "session_id").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("file_path").alias("files"))


@query("""WITH s AS (SELECT project_id, session_id, arg_min(epoch_us(created_at), seq) AS a, arg_max(epoch_us(created_at), seq) AS b FROM sess JOIN det USING (project_id) WHERE seq > start_seq AND seq <= end_seq GROUP BY ALL)
SELECT s.project_id, session_id, count(*) AS incidents FROM s JOIN det ON det.project_id = s.project_id AND epoch_us(created_at) BETWEEN a AND b WHERE define_name = 'error' GROUP BY ALL""")
def session_incidents(spark, sf_dir):
    """C11: incidents (error events here) created while an ended session ran."""
    det = A.determinations(spark, sf_dir).withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")))
    inside = I.within(det, A.sessions(spark, sf_dir).where("end_seq is not null"), ["project_id"], "seq", "start_seq", "end_seq")
    spans = inside.groupBy("project_id", "session_id").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    hits = I.within(det.where("define_name = 'error'").select("project_id", "at"), spans, ["project_id"], "at", "a", "b", width=3_600_000_000, open_low=False)
    return hits.groupBy("project_id", "session_id").agg(F.count(F.lit(1)).alias("incidents"))


_ROUNDS = f"""r AS (SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) AS round, coalesce(lag(seq) OVER (PARTITION BY {KEY} ORDER BY seq), 0) AS low, seq AS high FROM det),
r5 AS (SELECT * FROM r WHERE round <= 5 UNION ALL SELECT {KEY}, 0, max(seq), 1000000000 FROM det GROUP BY ALL),
sig AS (SELECT {', '.join('r5.' + k.strip() for k in KEY.split(','))}, round, arg_max(sig, crash.seq) AS signature FROM r5 LEFT JOIN crash ON crash.project_id = r5.project_id AND crash.seq > low AND crash.seq <= high AND sig IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_ROUNDS} SELECT {KEY}, CAST(round AS BIGINT) AS round, signature FROM sig")
def crash_rounds(spark, sf_dir):
    return I.round_signatures(A.determinations(spark, sf_dir), A.crashes(spark, sf_dir), C.CHAIN).select(*C.CHAIN, "round", "signature")


@query(f"""WITH {_ROUNDS}, z AS (SELECT {KEY}, max(CASE WHEN round = 0 THEN signature END) AS cur, min(CASE WHEN round > 0 THEN signature END) AS lo, max(CASE WHEN round > 0 THEN signature END) AS hi FROM sig GROUP BY ALL)
SELECT {KEY}, CASE WHEN cur IS NULL AND hi IS NULL THEN 'no_data' WHEN cur IS NULL THEN 'resolved' WHEN hi IS NULL THEN 'no_data' WHEN lo = cur AND hi = cur THEN 'type1' ELSE 'type2' END AS evolution FROM z""")
def error_evolution(spark, sf_dir):
    rounds = I.round_signatures(A.determinations(spark, sf_dir), A.crashes(spark, sf_dir), C.CHAIN)
    return I.error_evolution(rounds, C.CHAIN)


@query("""WITH a AS (SELECT project_id, id AS artifact, epoch_us(created_at) + CASE WHEN id % 2 = 0 THEN 2220000000 ELSE -2220000000 END AS m FROM det WHERE id % 10 = 0),
p AS (SELECT a.*, d.seq AS ps, a.m - epoch_us(d.created_at) AS pd FROM a ASOF LEFT JOIN det d ON d.project_id = a.project_id AND a.m >= epoch_us(d.created_at)),
n AS (SELECT a.artifact, d.seq AS ns, epoch_us(d.created_at) - a.m AS nd FROM a ASOF LEFT JOIN det d ON d.project_id = a.project_id AND a.m <= epoch_us(d.created_at))
SELECT project_id, p.artifact, CASE WHEN ps IS NULL OR nd < pd THEN ns ELSE ps END AS seq FROM p JOIN n USING (artifact)""")
def nearest_seq(spark, sf_dir):
    det = A.determinations(spark, sf_dir).withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")))
    shift = F.when(F.col("id") % 2 == 0, 2_220_000_000).otherwise(-2_220_000_000)
    artifacts = det.where("id % 10 = 0").select("project_id", F.col("id").alias("artifact"), (F.col("at") + shift).alias("m"))
    return I.nearest(artifacts, det, ["project_id"], "m", "at", "seq", width=21_600_000_000).select("project_id", "artifact", "seq")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber AS define, min(CAST(l_quantity AS BIGINT)) * 10 AS a, min(CAST(l_quantity AS BIGINT)) * 10 + 60 AS b FROM lineitem GROUP BY 1, 2),
p AS (SELECT DISTINCT l_orderkey, CAST(l_extendedprice AS BIGINT) % 500 AS line FROM lineitem)
SELECT l_orderkey AS file_id, CAST(define AS BIGINT) AS define_id, count(*) AS lines FROM d JOIN p USING (l_orderkey) WHERE line BETWEEN a AND b GROUP BY ALL""")
def line_range_cover(spark, sf_dir):
    """Covered lines within the line range of a define of the same file; orders stand for files."""
    li = A.raw(spark, sf_dir, "lineitem")
    low = F.min(F.round("l_quantity").cast("long")) * 10
    defines = li.groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("long").alias("define_id")).agg(low.alias("a")).withColumn("b", F.col("a") + 60)
    lines = li.select(F.col("l_orderkey").alias("file_id"), (F.bround("l_extendedprice").cast("long") % 500).alias("line")).distinct()
    return I.within(lines, defines, ["file_id"], "line", "a", "b", width=64, open_low=False).groupBy("file_id", "define_id").agg(F.count(F.lit(1)).alias("lines"))


@query("""WITH f AS (SELECT DISTINCT 'w/' || user_id % 10 || '/' || user_id || '/' || event_type || '.py' AS path FROM events),
r AS (SELECT DISTINCT 'w/' || user_id % 10 AS root_path, user_id % 10 AS project FROM events UNION SELECT DISTINCT 'w/' || user_id % 10 || '/' || user_id, 1000 + user_id FROM events WHERE user_id % 4 = 0)
SELECT path, arg_max(root_path, length(root_path)) AS root_path, arg_max(project, length(root_path)) AS project FROM f JOIN r ON starts_with(path, root_path || '/') GROUP BY 1""")
def longest_prefix_project(spark, sf_dir):
    e = A.raw(spark, sf_dir, "events")
    top = F.concat_ws("/", F.lit("w"), F.col("user_id") % 10)
    files = e.select(F.concat(F.concat_ws("/", top, F.col("user_id"), F.col("event_type")), F.lit(".py")).alias("path")).distinct()
    roots = e.select(top.alias("root_path"), (F.col("user_id") % 10).alias("project")).union(e.where("user_id % 4 = 0").select(F.concat_ws("/", top, F.col("user_id")), F.col("user_id") + 1000)).distinct()
    return I.longest_prefix(files, roots)
