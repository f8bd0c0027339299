import json

from pyspark.sql import functions as F

from chronoweave.operators import registers as R


def test_scopes_levels_and_nets(spark):
    commands = spark.createDataFrame([(1, 1, "set", ["a/*"], None), (1, 2, "set", ["b/*"], ["c"]), (2, 1, "set", ["x"], []), (2, 5, "clear", None, None), (3, 1, "set", [], [])], "project_id long, seq long, action string, allowed array<string>, forbidden array<string>")
    assert [tuple(r) for r in R.active_scopes(commands).collect()] == [(1, ["b/*"], ["c"])]
    projects = spark.createDataFrame([(1,), (2,)], "project_id long")
    said = spark.createDataFrame([(1, 1, "high"), (1, 2, "loud"), (1, 3, "low")], "project_id long, seq long, level string")
    assert {r.project_id: r.level for r in R.levels(projects, said).collect()} == {1: "low", 2: "medium"}
    nets = spark.createDataFrame([(1, "tests", "trigger"), (1, "tests", "dismiss"), (1, "tests", "trigger"), (1, "vcs", "trigger")], "project_id long, net_type string, action string")
    assert {r.net_type: r.state for r in R.net_states(nets).collect()} == {"tests": "dismissed", "vcs": "triggered"}


def test_sessions_and_snapshots(spark):
    events = spark.createDataFrame([(1, "a", "session_start", 0), (1, "a", "session_start", 7), (1, "a", "stop", 9), (1, "b", "session_start", 9), (1, "c", "stop", 3), (1, None, "stop", 3)], "project_id long, session_id string, kind string, seq long")
    assert sorted(tuple(r) for r in R.sessions(events).collect()) == [(1, "a", 0, 9), (1, "b", 9, None)]
    commands = spark.createDataFrame([(1, 5, "git commit -m x", "h2"), (1, 8, "ls", "h2"), (1, 9, "git checkout main", "h3")], "project_id long, seq long, command string, head string")
    starts = spark.createDataFrame([(1, 1, "h1"), (1, 6, "h2"), (1, 10, "h9")], "project_id long, seq long, head string")
    assert sorted((r.seq, r.reason, r.head) for r in R.snapshots(commands, starts).collect()) == [(1, "initial", "h1"), (5, "commit", "h2"), (9, "branch_switch", "h3"), (10, "session_start", "h9")]


def test_reports_are_found_once(spark):
    listing = spark.createDataFrame([(1, "junit.xml", "m1"), (1, "target/surefire-reports/a.xml", "m1"), (1, "x/junit.xml", "m1"), (2, "junit.xml", "m1"), (2, "own.xml", "m2")], "project_id long, rel_path string, mtime string")
    configured = spark.createDataFrame([(1, "gone.xml"), (2, "own.xml")], "project_id long, report string")
    found = R.reports_found(listing, configured)
    assert sorted((r.project_id, r.rel_path) for r in found.collect()) == [(1, "junit.xml"), (1, "target/surefire-reports/a.xml"), (2, "own.xml")]
    runs = spark.createDataFrame([(1, "junit.xml", "m1"), (2, "own.xml", "m1")], "project_id long, source_path string, source_mtime string")
    assert sorted(r.rel_path for r in R.not_ingested(found, runs).collect()) == ["own.xml", "target/surefire-reports/a.xml"]


def test_messages_and_responses(spark):
    before = spark.createDataFrame([(1, "regression", "C::t", 1, 0)], "incident long, signal string, target_node string, agent int, user int")
    after = spark.createDataFrame([(1, "regression", "C::t", 1, 1), (2, "define_loop", "a.py::f", 1, 0)], before.schema)
    sent = {(r.incident, r.channel): r.message for r in R.deliveries(before, after).collect()}
    assert sent == {(1, "user"): "A test that passed before fails now: C::t.", (2, "agent"): "a.py::f is back at a form it had before. Find what made you leave it."}
    df = spark.createDataFrame([("PostToolUse", 'say "x"'), ("Stop", ""), ("Stop", None)], "e string, t string")
    got = [json.loads(r.r) for r in df.select(R.hook_response(F.col("e"), F.col("t")).alias("r")).collect()]
    assert got == [{"hookSpecificOutput": {"hookEventName": "PostToolUse", "additionalContext": 'say "x"'}}, {}, {}]
    box = spark.createDataFrame([(2, 1, "user", "alert", "b", None, 5), (1, 1, "user", "alert", "a", None, 9), (3, 1, "user", "suggestion", "c", None, 1), (4, 1, "user", "alert", "d", 1, 1), (5, 2, "agent", "alert", "e", None, 1)], "id long, project_id long, channel string, kind string, message string, taken_at long, created_us long")
    assert [json.loads(r.response) for r in R.stop_response(box).collect()] == [{"decision": "block", "reason": "a\n\nb"}]
    started = spark.createDataFrame([(1, 6)], "project_id long, started_us long")
    assert sorted(r.id for r in R.carried_over(box, started).collect()) == [2, 3]


def test_hints_and_new_members(spark):
    nodes = spark.createDataFrame([(1, "s", 20), (2, "t", 19), (3, "u", 50)], "project_id long, session_id string, graph_nodes long")
    hinted = spark.createDataFrame([(3, "u")], "project_id long, session_id string")
    assert [r.project_id for r in R.structure_hint(nodes, hinted).collect()] == [1]
    now = spark.createDataFrame([(1, "commit", ["b", "a"]), (2, "commit", ["a"]), (3, "commit", ["z"])], "project_id long, kind string, defines array<string>")
    told = spark.createDataFrame([(1, "commit", "a"), (2, "commit", "a,b")], "project_id long, kind string, csv string")
    assert {r.project_id: r.csv for r in R.new_members(now, told).collect()} == {1: "a,b", 3: "z"}


def test_details(spark):
    df = spark.createDataFrame([('{"rounds": 7, "x": {"y": 1}}',), ("broken",), (None,), ("{}",)], "d string")
    assert [r.r for r in df.select(R.detail(F.col("d"), "rounds").alias("r")).collect()] == ["7", None, None, None]
