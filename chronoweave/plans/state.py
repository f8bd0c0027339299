"""State that commands, sessions, reports and messages build up; recurrence of incidents; what one round leaves behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave import adapters as A
from chronoweave.functions import idents as N
from chronoweave.functions.messages import full_message, listed, message
from chronoweave.operators import association as S
from chronoweave.operators import chains as C
from chronoweave.operators import detectors as D
from chronoweave.operators import graph as G
from chronoweave.operators import intervals as I
from chronoweave.operators import maintenance as M
from chronoweave.operators import outcomes as O
from chronoweave.operators import ranks as K
from chronoweave.operators import recurrence as Q
from chronoweave.operators import registers as R
from chronoweave.scratch import stored
from chronoweave.sources import files as X

from .history import COMMIT, KEY, _history
from .registry import query

COMMANDS = ("git commit -m x", "git  reset --hard HEAD~1", "git checkout -- a.py", "git -C /p switch main", "git reset --soft x", "git stash pop", "git -c k=v commit", "  npm run  test ")


def _events(spark, sf_dir):
    """Events with k, as commands of projects: each user is one."""
    return A.raw(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))


# The last word of commands


@query("""WITH c AS (SELECT user_id, arg_max({'a': event_type, 'k': k}, event_id) AS c FROM ev GROUP BY 1)
SELECT user_id AS project_id, 'src/' || c.k || '/*' AS allowed, CASE WHEN c.a = 'purchase' THEN '*.lock' ELSE '' END AS forbidden FROM c WHERE c.a NOT IN ('click', 'error')""")
def task_scopes(spark, sf_dir):
    """Clicks clear a scope, errors set one without allowed patterns, which is none."""
    e, kind = _events(spark, sf_dir), F.col("event_type")
    none = F.array().cast("array<string>")
    commands = e.select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.when(kind == "click", "clear").otherwise("set").alias("action"), F.when(kind == "error", none).otherwise(F.array(F.concat(F.lit("src/"), "k", F.lit("/*")))).alias("allowed"), F.when(kind == "purchase", F.array(F.lit("*.lock"))).alias("forbidden"))
    return R.active_scopes(commands).select("project_id", F.array_join("allowed", ",").alias("allowed"), F.array_join("forbidden", ",").alias("forbidden"))


@query("""SELECT user_id AS project_id, coalesce(arg_max(CASE k % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'silent' END, event_id) FILTER (WHERE k % 6 < 4 AND event_type = 'click'), 'medium') AS level FROM ev GROUP BY 1""")
def notification_levels(spark, sf_dir):
    """Clicks set a level; two of six values are none."""
    e = _events(spark, sf_dir)
    said = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "silent", "loud", ""))), (F.col("k") % 6 + 1).cast("int"))
    commands = e.where("event_type = 'click'").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), said.alias("level"))
    return R.levels(e.select(F.col("user_id").alias("project_id")), commands)


@query("SELECT user_id AS project_id, event_type AS net_type, CASE WHEN max(k) >= 90 THEN 'dismissed' ELSE 'triggered' END AS state FROM ev GROUP BY 1, 2")
def net_dismissals(spark, sf_dir):
    e = _events(spark, sf_dir)
    return R.net_states(e.select(F.col("user_id").alias("project_id"), F.col("event_type").alias("net_type"), F.when(F.col("k") >= 90, "dismiss").otherwise("trigger").alias("action")))


@query("""WITH a AS (SELECT project_id, max(seq) AS top FROM det WHERE define_name = 'signup' AND k < 30 GROUP BY 1)
SELECT a.project_id, max(seq) AS last_commit_seq FROM a JOIN det ON det.project_id = a.project_id AND seq <= top GROUP BY 1""")
def commit_acknowledged(spark, sf_dir):
    """P08."""
    det = A.determinations(spark, sf_dir)
    commands = det.where("define_name = 'signup'").select("project_id", F.col("seq").alias("seq_at"), F.when(F.col("k") < 30, "acknowledge_commit").otherwise("other").alias("action"))
    return R.commit_points(commands, det)


@query("""SELECT DISTINCT s.project_id, s.session_id FROM sess s JOIN (SELECT project_id, session_id, count(*) AS n FROM sess JOIN det USING (project_id) WHERE seq > start_seq AND seq <= coalesce(end_seq, 1000000000) GROUP BY ALL) c USING (project_id, session_id)
WHERE n >= 20 AND start_seq // 100 % 3 > 0""")
def structure_hints(spark, sf_dir):
    """Every third session had its hint."""
    sessions = A.sessions(spark, sf_dir)
    rows = I.within(A.determinations(spark, sf_dir), sessions, ["project_id"], "seq", "start_seq", "end_seq").groupBy("project_id", "session_id").agg(F.count(F.lit(1)).alias("graph_nodes"))
    return R.structure_hint(rows, sessions.where("floor(start_seq / 100) % 3 = 0").select("project_id", "session_id"))


@query("""WITH n AS (SELECT user_id AS project_id, event_type AS kind, list_sort(list(DISTINCT 'f' || k % 7)) AS d, list_sort(list(DISTINCT 'f' || k % 7) FILTER (WHERE k < 60)) AS t FROM ev GROUP BY 1, 2)
SELECT project_id, kind, array_to_string(d, ',') AS csv FROM n WHERE len(list_filter(d, lambda x: NOT list_contains(coalesce(t, []), x))) > 0""")
def new_suggestions(spark, sf_dir):
    """Suggestions that name what the last one of the kind did not; sets travel as sorted text."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("project_id"), F.col("event_type").alias("kind"), "k", F.concat(F.lit("f"), F.col("k") % 7).alias("f"))
    now = e.groupBy("project_id", "kind").agg(F.collect_set("f").alias("defines"))
    told = e.where("k < 60").groupBy("project_id", "kind").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("csv"))
    return R.new_members(now, told)


# 2.Q, I11, A04, A12, A30: sessions, snapshots, reports, responses


@query("""SELECT 1 + user_id % 3 AS project_id, 's' || k % 40 AS session_id, min(event_id) FILTER (WHERE event_type = 'signup') AS start_seq, max(event_id) FILTER (WHERE event_type = 'purchase' AND k < 50) AS end_seq
FROM ev WHERE k % 11 > 0 GROUP BY 1, 2 HAVING min(event_id) FILTER (WHERE event_type = 'signup') IS NOT NULL""")
def hook_sessions(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "session_start").when((F.col("event_type") == "purchase") & (F.col("k") < 50), "stop").otherwise("post_edit")
    session = F.when(F.col("k") % 11 > 0, F.concat(F.lit("s"), F.col("k") % 40))
    return R.sessions(_events(spark, sf_dir).select((1 + F.col("user_id") % 3).alias("project_id"), session.alias("session_id"), kind.alias("kind"), F.col("event_id").alias("seq")))


@query("""WITH m AS (SELECT user_id AS project_id, event_id AS seq, 'h' || k % 9 AS head, CASE event_id % 8 WHEN 0 THEN 'commit' WHEN 1 THEN 'rollback' WHEN 2 THEN 'rollback' WHEN 3 THEN 'branch_switch' WHEN 5 THEN 'rollback' WHEN 6 THEN 'commit' END AS reason FROM ev WHERE event_type <> 'signup'),
s AS (SELECT user_id AS project_id, event_id AS seq, 'h' || k % 9 AS head, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ev WHERE event_type = 'signup'),
seen AS (SELECT project_id, head, min(seq) AS first FROM (SELECT project_id, head, seq FROM m WHERE reason IS NOT NULL UNION ALL SELECT project_id, head, seq FROM s WHERE n = 1) GROUP BY 1, 2)
SELECT project_id, seq, head, reason FROM m WHERE reason IS NOT NULL UNION ALL SELECT project_id, seq, head, 'initial' FROM s WHERE n = 1
UNION ALL SELECT s.project_id, s.seq, s.head, 'session_start' FROM s LEFT JOIN seen USING (project_id, head) WHERE n > 1 AND (first IS NULL OR first > s.seq)""")
def snapshot_marks(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.concat(F.lit("h"), F.col("k") % 9).alias("head"), "event_type")
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("seq") % 8 + 1).cast("int"))
    starts = e.where("event_type = 'signup'").drop("event_type")
    return R.snapshots(e.where("event_type <> 'signup'").withColumn("command", command).drop("event_type"), starts).select("project_id", "seq", "head", "reason")


_LISTING = """f AS (SELECT o_custkey AS project_id, CASE o_orderkey % 6 WHEN 0 THEN 'junit.xml' WHEN 1 THEN 'reports/junit.xml' WHEN 2 THEN 'target/surefire-reports/T' || o_orderkey || '.xml' WHEN 3 THEN 'a/junit.xml' WHEN 4 THEN 'out/' || o_custkey || '.xml' ELSE 'readme.md' END AS rel_path, max(o_orderkey) AS mtime FROM orders GROUP BY ALL),
r AS (SELECT f.* FROM f WHERE rel_path = 'out/' || project_id || '.xml' AND project_id % 2 = 0
 UNION ALL SELECT * FROM f WHERE regexp_matches(rel_path, '^(junit.xml|reports/junit.xml|target/surefire-reports/.*)$') AND NOT (project_id % 2 = 0 AND project_id IN (SELECT project_id FROM f WHERE rel_path = 'out/' || project_id || '.xml')))"""


def _located(spark, sf_dir):
    o, k = A.raw(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    path = F.when(k == 0, "junit.xml").when(k == 1, "reports/junit.xml").when(k == 2, F.concat(F.lit("target/surefire-reports/T"), "o_orderkey", F.lit(".xml"))).when(k == 3, "a/junit.xml").when(k == 4, F.concat(F.lit("out/"), "o_custkey", F.lit(".xml"))).otherwise("readme.md")
    listing = o.groupBy(F.col("o_custkey").alias("project_id"), path.alias("rel_path")).agg(F.max("o_orderkey").alias("mtime"))
    configured = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("project_id"), F.concat(F.lit("out/"), "o_custkey", F.lit(".xml")).alias("report")).distinct()
    return R.reports_found(listing, configured)


@query(f"WITH {_LISTING} SELECT * FROM r")
def reports_located(spark, sf_dir):
    """Projects of even number name a report of their own, which not all of them have."""
    return _located(spark, sf_dir)


@query(f"WITH {_LISTING} SELECT * FROM r WHERE NOT (mtime % 5 = 0 AND rel_path <> 'junit.xml')")
def reports_new(spark, sf_dir):
    """A report of the same time stamp was read already."""
    found = _located(spark, sf_dir)
    runs = found.where("mtime % 5 = 0").select("project_id", F.when(F.col("rel_path") == "junit.xml", "old/junit.xml").otherwise(F.col("rel_path")).alias("source_path"), F.col("mtime").alias("source_mtime"))
    return R.not_ingested(found, runs)


_MESSAGES = "msg AS (SELECT id, project_id, CASE WHEN signal = 'define_loop' THEN 'user' ELSE 'agent' END AS channel, CASE WHEN id % 2 = 0 THEN 'alert' ELSE 'suggestion' END AS kind, 'm' || id AS message, CASE WHEN state <> 'open' THEN updated_us END AS taken_at, created_us FROM inc)"


def _messages(spark, sf_dir):
    channel = F.when(F.col("signal") == "define_loop", "user").otherwise("agent")
    return A.incidents(spark, sf_dir).select("id", "project_id", channel.alias("channel"), F.when(F.col("id") % 2 == 0, "alert").otherwise("suggestion").alias("kind"), F.concat(F.lit("m"), "id").alias("message"), F.when(F.col("state") != "open", F.col("updated_us")).alias("taken_at"), "created_us")


@query(f"""WITH {_MESSAGES} SELECT project_id, '{{"decision":"block","reason":"' || string_agg(message, '\\n\\n' ORDER BY id) || '"}}' AS response FROM msg WHERE channel = 'user' AND kind = 'alert' AND taken_at IS NULL GROUP BY 1""")
def stop_decisions(spark, sf_dir):
    """Untaken alerts to the user block a stop; suggestions do not."""
    return R.stop_response(_messages(spark, sf_dir))


@query("""SELECT id, CASE WHEN state = 'open' THEN '{}' ELSE '{"hookSpecificOutput":{"hookEventName":"PostToolUse","additionalContext":"' || target_node || '"}}' END AS response FROM inc""")
def hook_responses(spark, sf_dir):
    """Nothing to say is an empty object."""
    return A.incidents(spark, sf_dir).select("id", R.hook_response(F.lit("PostToolUse"), F.when(F.col("state") != "open", F.col("target_node"))).alias("response"))


@query(f"""WITH {_MESSAGES}, st AS (SELECT project_id, min(created_us) + 864000000000 AS started_us FROM msg GROUP BY 1) SELECT id, project_id FROM msg JOIN st USING (project_id) WHERE channel = 'user' AND taken_at IS NULL AND created_us < started_us""")
def messages_carried(spark, sf_dir):
    """2.Q: what the user was not told before a session that began on the tenth day."""
    rows = _messages(spark, sf_dir)
    started = rows.groupBy("project_id").agg((F.min("created_us") + 864_000_000_000).alias("started_us"))
    return R.carried_over(rows, started).select("id", "project_id")


@query("""SELECT id, CASE WHEN id % 4 > 0 THEN 'c' || id % 9 END AS classname, CASE WHEN id % 4 = 2 THEN '7' END AS rounds FROM inc""")
def incident_details(spark, sf_dir):
    """Fields of details; malformed ones have none."""
    i = A.incidents(spark, sf_dir)
    k = F.col("id") % 4
    text = F.when(k == 0, '{"classname": ').when(k == 2, F.format_string('{"classname": "c%d", "rounds": 7}', F.col("id") % 9)).otherwise(F.format_string('{"classname": "c%d", "test_cases": ["a"]}', F.col("id") % 9))
    return i.select("id", R.detail(text, "classname").alias("classname"), R.detail(text, "rounds").alias("rounds"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN E'\\nRounds: 7' WHEN 1 THEN E'\\nFailing: a, b, c +1 more' WHEN 2 THEN E'\\nRounds: 2\\nLook at: x' ELSE '' END AS more FROM inc""")
def message_details(spark, sf_dir):
    """What follows an incident's sentence."""
    i, k = A.incidents(spark, sf_dir), F.col("id") % 4
    details = F.when(k == 0, '{"rounds": 7}').when(k == 1, '{"test_cases": ["a", "b", "c", "d"], "rounds": null}').when(k == 2, '{"suspects": ["x"], "rounds": "2"}').otherwise("{")
    text = full_message(F.col("signal"), F.col("target_node"), F.lit("user"), details)
    plain = message(F.col("signal"), F.col("target_node"), F.lit("user"))
    return i.select("id", F.substr(text, F.length(plain) + 1).alias("more"))


@query("SELECT id, signal FROM inc WHERE state <> 'resolved'")
def unresolved_incidents(spark, sf_dir):
    """P01."""
    return R.unresolved(A.incidents(spark, sf_dir)).select("id", "signal")


@query("""SELECT CAST(id AS BIGINT) AS incident, c AS channel, count(*) AS n FROM (SELECT id, unnest(CASE state WHEN 'open' THEN [] WHEN 'notified_agent' THEN ['agent'] WHEN 'escalated_user' THEN ['agent', 'user'] ELSE ['agent'] END) AS c FROM inc) GROUP BY 1, 2""")
def messages_sent(spark, sf_dir):
    """A message for each count that rose."""
    rows = A.incidents(spark, sf_dir).select(F.col("id").alias("incident"), "signal", "target_node", "state")
    before = rows.select("incident", "signal", "target_node", F.lit(0).alias("agent"), F.lit(0).alias("user"))
    after = rows.select("incident", "signal", "target_node", (F.col("state") != "open").cast("int").alias("agent"), (F.col("state") == "escalated_user").cast("int").alias("user"))
    return R.deliveries(before, after).groupBy("incident", "channel").agg(F.count(F.lit(1)).alias("n"))


# C04, C12, C20, C24, C25, C27, E04, H17, H18, J04, J08, J11, F08, F09, I06, I08


@query("SELECT classname, max(run) AS run, arg_max(status, run) AS status FROM cases GROUP BY 1")
def newest_runs(spark, sf_dir):
    """Rows whose run is the greatest of their class."""
    return K.last_row(A.test_cases(spark, sf_dir), ["classname"], "test_run_id", ["test_run_id", "status"]).select("classname", F.col("test_run_id").alias("run"), "status")


@query("""WITH f AS (SELECT DISTINCT 'w/' || user_id % 10 || '/' || user_id || '/x.py' AS path, CASE event_type WHEN 'click' THEN 'main' WHEN 'view' THEN 'dev' WHEN 'error' THEN 'gone' END AS branch FROM events),
p AS (SELECT r.a * 10 + b.i AS project_id, 'w/' || r.a AS root_path, b.n AS branch FROM range(10) r(a), (VALUES (1, 'dev'), (2, 'main'), (3, NULL)) b(i, n)
 UNION ALL SELECT 1000 + user_id, 'w/' || user_id % 10 || '/' || user_id, 'dev' FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 = 0),
j AS (SELECT f.*, p.project_id, length(root_path) AS l, coalesce(f.branch = coalesce(p.branch, ''), false) AS fits FROM f JOIN p ON starts_with(path, root_path || '/'))
SELECT path, branch, project_id FROM j QUALIFY row_number() OVER (PARTITION BY path, branch ORDER BY l DESC, fits DESC, project_id) = 1""")
def branch_projects(spark, sf_dir):
    """The longest root, there the file's branch, else the first project."""
    e = A.raw(spark, sf_dir, "events")
    top = F.concat(F.lit("w/"), F.col("user_id") % 10)
    kind = F.col("event_type")
    files = e.select(F.concat_ws("/", top, "user_id", F.lit("x.py")).alias("path"), F.when(kind == "click", "main").when(kind == "view", "dev").when(kind == "error", "gone").alias("branch")).distinct()
    shared = spark.range(10).select((F.col("id") * 10 + 1).alias("p"), F.concat(F.lit("w/"), "id").alias("root_path"))
    projects = shared.select(F.col("p").alias("project_id"), "root_path", F.lit("dev").alias("branch")).union(shared.select(F.col("p") + 1, "root_path", F.lit("main"))).union(shared.select(F.col("p") + 2, "root_path", F.lit(None).cast("string")))
    own = e.where("user_id % 4 = 0").select((1000 + F.col("user_id")).alias("project_id"), F.concat_ws("/", top, "user_id").alias("root_path"), F.lit("dev").alias("branch")).distinct()
    return I.project_of(files, projects.union(own)).select("path", "branch", "project_id")


_CASES = "cs AS (SELECT DISTINCT 'tests.test_s' || s_suppkey % 50 AS classname, 'test_load_' || s_suppkey % 40 AS name FROM supplier)"


@query(f"""WITH {_CASES}, a AS (SELECT p_partkey AS define_key, classname, name, 1 AS tier FROM part JOIN cs ON name = 'test_load_' || p_partkey % 40 AND classname = 'tests.test_s' || p_partkey % 50 WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, classname, name, 2 FROM part JOIN cs ON name = 'test_load_' || p_partkey % 60 WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, classname, name, 3 FROM part JOIN cs ON classname = 'tests.test_s' || p_partkey % 70 WHERE p_partkey % 3 = 2) SELECT * FROM a""")
def associated_cases(spark, sf_dir):
    """C20: parts modulo three are found by coverage, by name, by file stem."""
    p, s, k = A.raw(spark, sf_dir, "part"), A.raw(spark, sf_dir, "supplier"), F.col("p_partkey") % 3
    cases = s.select(F.concat(F.lit("tests.test_s"), F.col("s_suppkey") % 50).alias("classname"), F.concat(F.lit("test_load_"), F.col("s_suppkey") % 40).alias("name")).distinct()
    name = F.when(k == 0, F.concat(F.lit("calc_"), "p_partkey")).when(k == 1, F.concat(F.lit("load_"), F.col("p_partkey") % 60)).otherwise(F.concat(F.lit("zz_"), "p_partkey"))
    defines = p.select(F.col("p_partkey").alias("define_key"), F.when(k == 2, F.concat(F.lit("src/s"), F.col("p_partkey") % 70, F.lit(".py"))).otherwise("src/x.py").alias("file_path"), name.alias("define_name"))
    coverage = p.where(k == 0).select(F.concat(F.lit("calc_"), "p_partkey").alias("define_name"), F.concat(F.lit("tests.test_s"), F.col("p_partkey") % 50).alias("classname"), F.concat(F.lit("test_load_"), F.col("p_partkey") % 40).alias("name"))
    return S.associated_cases(defines, coverage, cases).select("define_key", "classname", "name", "tier")


_STACKS = "sx AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id DESC) AS n, unnest([file_path || '::view', file_path || '::click']) AS node FROM det WHERE define_name = 'error')"


def _stacks(spark, sf_dir):
    frames = F.array(*[F.concat("file_path", F.lit(f"::{x}")) for x in ("view", "click")])
    return A.determinations(spark, sf_dir).where("define_name = 'error'").select("project_id", "id", frames.alias("stack_fqns"))


@query("""WITH sx AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id DESC) AS n, file_path FROM det WHERE define_name = 'error'),
c AS (SELECT DISTINCT project_id, file_path || '::' || define_name AS node FROM det WHERE k < 90)
SELECT project_id, node FROM c WHERE (project_id, node) IN (SELECT project_id, file_path || '::view' FROM sx WHERE n <= 3 UNION SELECT project_id, file_path || '::click' FROM sx WHERE n <= 3)""")
def crash_suspects(spark, sf_dir):
    """Of each project the nodes of its cone on its own last three crash stacks."""
    cone = A.determinations(spark, sf_dir).where("k < 90").select("project_id", F.concat_ws("::", "file_path", "define_name").alias("node")).distinct()
    return G.suspects(cone, _stacks(spark, sf_dir)).select("project_id", "node")


@query("""WITH x AS (SELECT p_partkey AS t, a AS n FROM part JOIN anc ON node = p_partkey WHERE a > 0), st AS (SELECT DISTINCT l_partkey % 40 AS n FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 DESC LIMIT 5)),
c AS (SELECT t, n, 0 AS w FROM x WHERE n IN (SELECT n FROM st)), d AS (SELECT x.t, x.n, count(b.a) AS w FROM x LEFT JOIN (SELECT node, a FROM anc WHERE a > 0) b ON b.node = x.n WHERE t NOT IN (SELECT t FROM c) GROUP BY 1, 2),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY t ORDER BY n) <= 3 UNION ALL SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY t ORDER BY w DESC, n) <= 3)
SELECT p_partkey AS node, array_to_string(list(n ORDER BY w DESC, n), ',') AS suspects FROM part LEFT JOIN f ON t = p_partkey GROUP BY 1""")
def define_loop_suspects(spark, sf_dir):
    """Callees on the last five stacks, else those with most callees of their own."""
    calls = A.calls(spark, sf_dir).where("callee > 0")
    stacks = A.raw(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey") % 40).alias("stack_fqns"))
    found = G.loop_suspects(A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), calls, stacks)
    return found.select("node", F.array_join(F.transform("suspects", lambda x: x.cast("string")), ",").alias("suspects"))


@query("SELECT 'py::m.p' || p_partkey AS node FROM part WHERE p_size > 20")
def alive_defines(spark, sf_dir):
    """Members know defines without their language."""
    p = A.raw(spark, sf_dir, "part")
    return G.alive(p.select(F.concat(F.lit("py::m.p"), "p_partkey").alias("node")), p.where("p_size > 20").select(F.concat(F.lit("m.p"), "p_partkey").alias("member")))


@query("""SELECT DISTINCT classname, name FROM cases WHERE (CAST(replace(classname, 'tests.C', '') AS BIGINT) % 3 = 0 AND name = '1-URGENT') OR (CAST(replace(classname, 'tests.C', '') AS BIGINT) % 5 = 0) OR (CAST(replace(classname, 'tests.C', '') AS BIGINT) % 7 = 0 AND name = '2-HIGH')""")
def edited_cases(spark, sf_dir):
    """A class edited as a whole, or its method."""
    cases = A.test_cases(spark, sf_dir).select("classname", "name").distinct()
    c = cases.withColumn("c", F.substring_index("classname", ".", -1)).withColumn("n", F.substring("c", 2, 20).cast("long"))
    edited = c.where("n % 3 = 0").select(F.concat(F.col("c"), F.lit(".1-URGENT")).alias("define_name")).union(c.where("n % 5 = 0").select("c")).union(c.where("n % 7 = 0").select(F.concat(F.col("c"), F.lit(".2-HIGH"))))
    return S.edited_cases(cases, edited)


_GREEN = "g AS (SELECT classname, name, CAST(replace(classname, 'tests.C', '') AS BIGINT) AS c, arg_max(status, run) AS st, max(run) AS lr, min(CASE WHEN status = 'failed' THEN run END) AS ff, max(CASE WHEN status = 'failed' THEN run END) AS lf FROM cases GROUP BY ALL)"


@query(f"""WITH {_GREEN}, ch AS (SELECT DISTINCT g.classname, g.name, file_path || '::' || define_name AS key FROM g JOIN det ON user_id = c AND id > lf AND id <= lr WHERE st = 'passed' AND ff < lr),
w AS (SELECT ch.classname, ch.name FROM ch WHERE key NOT IN (SELECT file_path || '::' || define_name FROM cov WHERE user_key % 2 = 0) OR (key, ch.classname, ch.name) IN (SELECT file_path || '::' || define_name, classname, name FROM cov WHERE user_key % 2 = 0))
SELECT CAST(1 AS BIGINT) AS project_id, 'test_tampering' AS signal, classname || '::' || name AS target_node FROM g WHERE st = 'passed' AND ff < lr AND (c % 3 = 0 OR name = '5-LOW') AND (classname, name) NOT IN (SELECT * FROM w)""".replace("cov WHERE user_key % 2 = 0", "cov WHERE name <> '5-LOW'"))
def tampering_precise(spark, sf_dir):
    """Edits of the test's own define, and changes that do not count since their coverage is known and holds
    other cases only. The lowest priority's cases are in no coverage."""
    green = stored(O.last_red(_history(spark, sf_dir)).withColumn("c", F.regexp_replace("classname", "tests.C", "").cast("long")))
    cases = green.select("classname", "name", "c").distinct()
    edited = cases.where("c % 3 = 0").select(F.concat(F.lit("C"), "c").alias("define_name")).union(cases.select(F.lit("5-LOW")))
    windows = green.select("classname", "name", F.col("c").alias("user_id"), F.col("red_seq").alias("low"), F.col("green_seq").alias("high"))
    key = F.concat_ws("::", "file_path", "define_name").alias("define_key")
    events = A.edits(spark, sf_dir).select("user_id", F.col("id").alias("at"), key)
    changes = I.within(events, windows, ["user_id"], "at", "low", "high").select("classname", "name", "define_key").distinct()
    precise = stored(A.coverage(spark, sf_dir).where("name <> '5-LOW'").select(key, "classname", "name"))
    return D.test_tampering(green, S.edited_cases(cases, edited), D.explained(changes, precise))


@query("SELECT 1 + user_id % 3 AS project_id, 'ts_toolchain_missing' AS signal, 'w/' || user_id || '.ts' AS target_node FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click')) WHERE user_id % 2 = 0 UNION SELECT 1 + user_id % 3, 'ts_toolchain_missing', 'w/' || user_id || '.tsx' FROM events WHERE event_type IN ('view', 'click') AND user_id % 2 = 1 AND user_id % 3 = 0")
def sig_toolchain_missing(spark, sf_dir):
    """TypeScript files; with a compiler there is nothing to say."""
    u = F.col("user_id")
    end = F.when(u % 2 == 0, ".ts").when(u % 3 == 0, ".tsx").otherwise(".js")
    changed = A.raw(spark, sf_dir, "events").where("event_type in ('view', 'click')").select((1 + u % 3).alias("project_id"), F.concat(F.lit("w/"), u, end).alias("file_path"))
    return D.toolchain_missing(changed, False).unionByName(D.toolchain_missing(changed, True))


@query(f"""WITH sn AS (SELECT project_id, 'c' || n || 'f' AS h, max(seq) AS s FROM (SELECT project_id, seq, 1 + (seq - 1) * 10 // max(seq) OVER (PARTITION BY project_id) AS n FROM det) GROUP BY 1, n),
a AS (SELECT project_id, arg_max(s, s) AS a FROM sn WHERE h LIKE 'c2%' GROUP BY 1), b AS (SELECT project_id, max(s) AS b FROM sn WHERE h LIKE 'c1%' GROUP BY 1),
x AS (SELECT {KEY}, arg_max(CASE WHEN edit_type <> 'delete' THEN content_hash ELSE '-' END, CASE WHEN seq <= a THEN seq END) AS p, arg_max(CASE WHEN edit_type <> 'delete' THEN content_hash ELSE '-' END, CASE WHEN seq <= b THEN seq END) AS q FROM det JOIN a USING (project_id) JOIN b USING (project_id) GROUP BY ALL),
y AS (SELECT {KEY}, nullif(p, '-') AS before_hash, nullif(q, '-') AS after_hash FROM x)
SELECT {KEY}, before_hash, after_hash, CASE WHEN before_hash IS NULL THEN 'added' WHEN after_hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM y WHERE before_hash IS DISTINCT FROM after_hash""")
def commits_diff(spark, sf_dir):
    """Each project's own snapshots, found by a prefix of the commit: c2, and the newest of c1 and c10."""
    det = A.determinations(spark, sf_dir)
    top = det.groupBy("project_id").agg(F.max("seq").alias("top"))
    part = 1 + F.floor((F.col("seq") - 1) * 10 / F.col("top"))
    marks = det.join(top, "project_id").groupBy("project_id", part.alias("n")).agg(F.max("seq").alias("snapshot_at_seq"))
    marks = marks.select("project_id", "snapshot_at_seq", F.concat(F.lit("c"), "n", F.lit("f")).alias("commit_hash"), F.col("snapshot_at_seq").alias("taken_at"), F.col("n").alias("id"))
    return C.diff_commits(det, marks, "c2", "c1")


@query("SELECT f.p_partkey + 5000000 AS from_det, t.p_partkey + 5000000 AS to_det FROM calls JOIN part f ON f.p_partkey = callee JOIN part t ON t.p_partkey = caller WHERE f.p_size > 5 AND t.p_size > 5 AND f.p_partkey <> t.p_partkey")
def current_edges(spark, sf_dir):
    """From what is called to what calls it, between current versions."""
    now = A.raw(spark, sf_dir, "part").where("p_size > 5").select(F.concat(F.lit("p"), "p_partkey").alias("fqn"), (F.col("p_partkey") + 5_000_000).alias("id"))
    calls = A.calls(spark, sf_dir).select(F.concat(F.lit("p"), "caller").alias("caller"), F.concat(F.lit("p"), "callee").alias("callee"))
    return G.current_edges(calls, now)


@query("""WITH big AS (SELECT f AS node, count(*) AS callers FROM gd GROUP BY 1 HAVING count(*) >= 5), s AS (SELECT DISTINCT 1 + user_id % 3 AS project_id, 's' || user_id % 20 AS session_id, user_id % 100 AS node FROM events)
SELECT project_id, session_id, node, callers FROM s JOIN big USING (node) WHERE NOT (project_id = 2 AND node % 2 = 0)""")
def high_impact_once(spark, sf_dir):
    """Sessions that edit a define with many users hear of it once; those of project 2 have heard of even ones."""
    big = G.high_impact(A.gd_edges(spark, sf_dir), A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")))
    u = F.col("user_id")
    found = A.raw(spark, sf_dir, "events").select((1 + u % 3).alias("project_id"), F.concat(F.lit("s"), u % 20).alias("session_id"), (u % 100).alias("node")).join(big, "node")
    warned = found.where("project_id = 2 and node % 2 = 0")
    return G.not_warned(found, warned, ["project_id", "session_id", "node"]).select("project_id", "session_id", "node", "callers")


@query("""WITH q AS (SELECT caller AS u, callee AS v FROM calls), w AS (SELECT u, v, count(*) AS c FROM q JOIN anc x ON x.node = u JOIN anc y ON y.node = v AND y.a = x.a GROUP BY 1, 2),
l AS (SELECT u, list('p' || v ORDER BY c DESC, v) AS names FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY u ORDER BY c DESC, v) <= 5) GROUP BY 1)
SELECT p_partkey AS node, coalesce(array_to_string(names[1:1], ', ') || CASE WHEN len(names) > 1 THEN ' +' || (len(names) - 1) || ' more' ELSE '' END, '') AS shared FROM part LEFT JOIN l ON u = p_partkey""")
def shared_ancestry(spark, sf_dir):
    """The five callees with most ancestors in common, the first shown, the others counted."""
    targets = A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    rows = D.lateral_structure(targets, A.calls(spark, sf_dir), A.gd_edges(spark, sf_dir))
    names = F.transform(F.slice(F.coalesce("shared_ancestry", F.array().cast("array<struct<callee:bigint,omega:bigint>>")), 1, 5), lambda x: F.concat(F.lit("p"), x["callee"]))
    return rows.select("node", listed(names, 1).alias("shared"))


@query("SELECT l_partkey % 50 AS source_file, l_suppkey AS callee, CASE WHEN l_partkey % 50 < 10 THEN 'new' ELSE 'old' END AS kind, count(*) AS n FROM lineitem WHERE l_partkey % 50 >= 10 OR l_quantity > 25 GROUP BY 1, 2, 3")
def edges_replaced(spark, sf_dir):
    """All edges of ten rebuilt files give way to what they have now."""
    li = A.raw(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("source_file"), F.col("l_suppkey").alias("callee"), "l_quantity")
    old, new = li.withColumn("kind", F.lit("old")).drop("l_quantity"), li.where("source_file < 10 and l_quantity > 25").withColumn("kind", F.lit("new")).drop("l_quantity")
    return M.replaced(old, new, ["source_file"]).groupBy("source_file", "callee", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH n AS (SELECT {KEY}, content_hash FROM det QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) = 1), e AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path, define_name) AS seq FROM n)
SELECT {KEY}, content_hash, 'create' AS edit_type, seq, max(seq) OVER (PARTITION BY project_id) AS snapshot_at_seq FROM e""")
def full_ingest(spark, sf_dir):
    """The first look at a project: all its defines in one job, and a snapshot at the end."""
    events, marks = M.ingested(C.current_version(A.determinations(spark, sf_dir)), "h0", "main")
    return events.select(*C.CHAIN, "content_hash", "edit_type", "seq").join(marks.select("project_id", "snapshot_at_seq"), "project_id")


# Files and names


@query("""WITH f AS (SELECT DISTINCT 'tests/C' || c_custkey || '.py' AS p FROM customer WHERE c_nationkey < 12)
SELECT run AS test_run_id, classname, name, CASE WHEN name = '1-URGENT' THEN 'x/' || run || '.py' ELSE p END AS file_path FROM cases LEFT JOIN f ON p = replace(classname, '.', '/') || '.py'""")
def case_files(spark, sf_dir):
    """A case's own file, or the module's if the listing has it."""
    from chronoweave.sources.artifacts import case_files as found

    cases = A.test_cases(spark, sf_dir).withColumn("file", F.when(F.col("name") == "1-URGENT", F.concat(F.lit("x/"), "test_run_id", F.lit(".py"))))
    files = A.raw(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.concat(F.lit("tests/C"), "c_custkey", F.lit(".py")).alias("rel_path"))
    return found(cases, files).select("test_run_id", "classname", "name", "file_path")


@query("""WITH l AS (SELECT 'd' || p_partkey % 20 || '/p' || p_partkey || '.py' AS path, 'd' || p_partkey % 20 AS dir, CASE WHEN p_size > 5 THEN p_size END AS now, p_partkey % 3 > 0 AS known, CASE WHEN p_partkey % 4 > 0 THEN 25 END AS was FROM part)
SELECT path, CASE WHEN now IS NULL THEN 'missing' WHEN NOT known THEN 'new' ELSE 'touched' END AS change FROM l WHERE (now IS NULL AND known) OR (now IS NOT NULL AND NOT known AND regexp_extract(dir, '[0-9]+')::INT < 15) OR (now IS NOT NULL AND known AND (was IS NULL OR now > was))""")
def disk_changes(spark, sf_dir):
    """Missing, touched and new files, new ones in changed folders only; each path once."""
    p = A.raw(spark, sf_dir, "part")
    path = F.concat(F.lit("d"), F.col("p_partkey") % 20, F.lit("/p"), "p_partkey", F.lit(".py")).alias("path")
    listing = p.where("p_size > 5").select(path, F.col("p_size").alias("mtime"))
    recorded = p.where("p_partkey % 3 > 0").select(path, F.when(F.col("p_partkey") % 4 > 0, 25).alias("mtime"))
    folders = spark.range(15).select(F.concat(F.lit("d"), "id").alias("dir"))
    return X.disk_changes(listing, recorded, folders)


@query("""SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN 'b' || p_size WHEN 1 THEN 'c' || p_size WHEN 5 THEN 'd ' || p_size END AS name FROM part WHERE p_partkey % 7 IN (0, 1, 5)""")
def ignore_rules(spark, sf_dir):
    """Folders by name; comments, negations, patterns and nested paths are not looked at."""
    p = A.raw(spark, sf_dir, "part")
    forms = ("/b%d/", " c%d ", "# d%d", "!e%d", "f*%d", "d %d", "g/h%d")
    line = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        line = F.when(F.col("p_partkey") % 7 == i, F.format_string(form, "p_size")).otherwise(line)
    return X.ignored_folders(p.select(line.alias("line")))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'a/f' || p_partkey WHEN 1 THEN 'f' || p_partkey WHEN 2 THEN 'f' || p_partkey WHEN 3 THEN 'z' || p_partkey WHEN 4 THEN 'g/h' || p_partkey ELSE 'k' || p_partkey END AS path FROM part""")
def comparable_paths(spark, sf_dir):
    """Folders that are left again are folded however many there are."""
    p = A.raw(spark, sf_dir, "part")
    forms = ("/r/x/../a/f%d", "./b/c/d/e/../../../../f%d", "/q/f%d", "../../z%d", "g//./h%d", "/r/../../r/a/b/c/d/../../../../k%d")
    path = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        path = F.when(F.col("p_partkey") % 6 == i, F.format_string(form, "p_partkey")).otherwise(path)
    return p.select(F.col("p_partkey").alias("id"), N.comparable(path, F.lit("/r")).alias("path"))


@query("SELECT m.p_partkey AS id, count(*) AS members FROM part m JOIN part d ON d.p_partkey // 10 = m.p_partkey OR d.p_partkey = m.p_partkey AND d.p_partkey >= 10 GROUP BY 1")
def module_members(spark, sf_dir):
    """Modules at or below another one, by the text before a dot; an underscore is no wildcard."""
    p = A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("pk_"), F.floor(F.col("p_partkey") / 10), F.lit(".m"), "p_partkey").alias("module"))
    of = p.select("id", F.concat(F.lit("pk_"), "id").alias("of"), F.col("module").alias("self"))
    found = p.select(F.explode(F.array(F.substring_index("module", ".", 1), F.col("module"))).alias("up"), "module").where("up <> module or substring_index(module, '.m', -1) >= 10")
    below = of.select("id", F.col("of").alias("up")).join(found, "up").where(N.in_module(F.col("module"), F.col("up"))).select("id", "module")
    at = of.select("id", F.col("self").alias("up")).join(found, "up").where(N.in_module(F.col("module"), F.col("up"))).select("id", "module")
    return below.union(at).groupBy("id").agg(F.count(F.lit(1)).alias("members"))


# 2.K: recurrence


_ROUND = f"""ir AS (SELECT id AS incident, project_id, file_path, define_name, user_id, k, ['stuck_region', 'define_loop', 'debug_loop', 'regression', 'test_tampering', 'boundary_breach', 'task_scope_breach', 'dangling_reference', 'parse_skipped', 'other'][id % 10 + 1] AS signal FROM det),
af AS (SELECT DISTINCT project_id, file_path, define_name FROM det WHERE seq > {COMMIT} AND project_id < 3),
cl AS (SELECT classname, name, arg_max(status, run) = 'failed' AS red FROM cases GROUP BY ALL),
ix AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq) AS i, count(*) OVER (PARTITION BY {KEY}) AS n FROM det),
fx AS (SELECT *, min(i) OVER (PARTITION BY {KEY}, node_fingerprint, fine_fingerprint) AS f FROM ix), bk AS (SELECT {KEY} FROM fx WHERE i = n AND i - f >= 2),
lv AS (SELECT {KEY} FROM det QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) = 1 AND edit_type <> 'delete')"""


@query(f"""WITH {_ROUND} SELECT incident, CASE signal WHEN 'stuck_region' THEN (project_id, file_path, define_name) IN (SELECT * FROM af)
WHEN 'define_loop' THEN (project_id, file_path, define_name) IN (SELECT * FROM af) AND (project_id, file_path, define_name) IN (SELECT * FROM bk)
WHEN 'debug_loop' THEN 'tests.C' || user_id IN (SELECT classname FROM cl WHERE red AND name IN ('1-URGENT', '2-HIGH'))
WHEN 'regression' THEN 'tests.C' || user_id IN (SELECT classname FROM cl WHERE red AND name = '3-MEDIUM')
WHEN 'test_tampering' THEN 'tests.C' || user_id IN (SELECT classname FROM cl WHERE name = '3-MEDIUM' AND (red OR ir.project_id = 3 OR NOT EXISTS (SELECT 1 FROM af)))
WHEN 'boundary_breach' THEN user_id % 2 = 0 WHEN 'task_scope_breach' THEN project_id <> 2 AND (project_id, file_path) IN (SELECT project_id, file_path FROM af) AND (file_path LIKE '%7.py' OR file_path NOT LIKE 'src/m1%')
WHEN 'dangling_reference' THEN k % 5 = 0 AND (project_id, file_path, define_name) IN (SELECT * FROM lv) WHEN 'parse_skipped' THEN true ELSE false END AS recurred,
CASE signal WHEN 'stuck_region' THEN 'stable_region' WHEN 'define_loop' THEN 'no_more_equiv' WHEN 'debug_loop' THEN 'test_passed' WHEN 'regression' THEN 'test_recovered' WHEN 'test_tampering' THEN 'really_fixed' WHEN 'boundary_breach' THEN 'back_in_scope' WHEN 'task_scope_breach' THEN 'back_in_scope' WHEN 'dangling_reference' THEN 'defined_or_removed' ELSE 'resolved' END AS reason FROM ir""")
def recurrence(spark, sf_dir):
    """2.K: every event is an incident; the round is what came after the last commit in two of three projects, the scope is
    that of projects 1 and 3. No project's last events are five in a row on one define here."""
    det = A.determinations(spark, sf_dir)
    names = ("stuck_region", "define_loop", "debug_loop", "regression", "test_tampering", "boundary_breach", "task_scope_breach", "dangling_reference", "parse_skipped", "other")
    signal = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 10 + 1).cast("int"))
    case = F.concat(F.lit("tests.C"), "user_id")
    target = F.when(signal.isin("boundary_breach", "task_scope_breach"), F.col("file_path")).otherwise(F.concat_ws("::", "file_path", "define_name"))
    callee = F.concat(F.lit("f"), "k")
    details = (
        F.when(signal == "debug_loop", F.to_json(F.struct(F.array(F.concat(case, F.lit("::1-URGENT")), F.concat(case, F.lit("::2-HIGH")), F.lit("broken")).alias("test_cases"))))
        .when(signal.isin("regression", "test_tampering"), F.to_json(F.struct(case.alias("classname"), F.lit("3-MEDIUM").alias("name"))))
        .when(signal == "dangling_reference", F.to_json(F.struct("file_path", F.col("define_name").alias("caller_define"), callee.alias("callee_text"))))
        .otherwise("not json")
    )
    incidents = det.select(F.col("id").alias("incident"), "project_id", signal.alias("signal"), target.alias("target_node"), details.alias("details"))
    affected = det.where(f"seq > {COMMIT} and project_id < 3").select(*C.CHAIN).distinct()
    history = _history(spark, sf_dir).withColumn("project_id", F.explode(F.array(*[F.lit(p).cast("long") for p in (1, 2, 3)])))
    breaches = det.where("user_id % 2 = 0").select("project_id", F.col("file_path").alias("path"))
    scopes = spark.createDataFrame([(1, ["src/m1*"], ["*7.py"]), (3, ["src/m1*"], ["*7.py"])], "project_id long, allowed array<string>, forbidden array<string>")
    dangling = det.where("k % 5 = 0").select("project_id", "file_path", F.col("define_name").alias("caller_define"), callee.alias("callee_text"))
    found = Q.recurred(incidents, affected, det, history, breaches, scopes, dangling)
    return found.join(incidents.select("incident", Q.resolved_by(F.col("signal")).alias("reason")), "incident").select("incident", "recurred", "reason")
