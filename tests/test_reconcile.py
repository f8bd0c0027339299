"""Rounds of reconciliation, by hand: events, calls, incidents through their states, messages, suggestions."""

from pyspark.sql import functions as F

from chronoweave.operators import reconcile as R

DEF = "project_id long, file_path string, define_name string, content_hash string, node_fingerprint string, fine_fingerprint string"


def test_rounds_by_hand(spark):
    tables = R.empty(spark)
    nothing = R.seen_nothing(spark)
    forms = ["a", "b", "a", "a2", "b", "b"]  # f returns to its first form in round 3
    cases, runs = [], []
    for n, form in enumerate(forms, 1):
        defines = [(1, "src/x.py", "f", form, form[0], form[0]), (1, "src/y.py", "g", "same", "g", "g")] + ([(1, "src/z.py", "h", "z", "h", "h")] if n < 4 else [])
        cases.append((n, "tests.t", "test_f", "failed" if n == 5 else "passed"))
        runs.append((n, 1, n))
        seen = R.replace(
            nothing,
            defines=spark.createDataFrame(defines, DEF),
            calls=spark.createDataFrame([(1, "src/y.py", "src/y.py::g", "src/x.py::f")], nothing.calls.schema),
            parse=spark.createDataFrame([(1, "src/bad.py", n >= 3)], nothing.parse.schema),
            cases=spark.createDataFrame(cases, nothing.cases.schema),
            runs=spark.createDataFrame(runs, nothing.runs.schema),
            coverage=spark.createDataFrame([(1, "src/x.py", "f", "tests.t", "test_f")], nothing.coverage.schema),
            scopes=spark.createDataFrame([(1, ["src/x*", "src/y*"], [])], nothing.scopes.schema),
            levels=spark.createDataFrame([(1, "high")], nothing.levels.schema),
        )
        tables, net, assist = R.round_(tables, seen, n)
    log = sorted((r.seq, r.file_path, r.edit_type, r.round) for r in tables.log.collect())
    assert log == [(1, "src/x.py", "create", 1), (2, "src/y.py", "create", 1), (3, "src/z.py", "create", 1), (4, "src/x.py", "modify", 2), (5, "src/x.py", "modify", 3), (6, "src/x.py", "modify", 4), (7, "src/z.py", "delete", 4), (8, "src/x.py", "modify", 5)]
    incidents = {(r.signal, r.target_node): (r.state, r.round) for r in tables.incidents.collect()}
    # the loop opens in round 3, recurs in 4 (back to an earlier form) and 5; with high notices the user hears at once; one quiet round so far
    assert incidents[("define_loop", "src/x.py::f")] == ("escalated_user", 3)
    assert incidents[("parse_skipped", "src/bad.py")] == ("resolved", 1)
    assert incidents[("task_scope_breach", "src/z.py")][1] == 1
    assert incidents[("regression", "tests.t::test_f")][1] == 5
    told = [(r.channel, r.round) for r in tables.messages.join(tables.incidents.where("signal = 'define_loop'").select("incident"), "incident").collect()]
    assert sorted(told) == [("agent", 3), ("user", 4)]
    ids = {r.define_name: r.id for r in tables.log.where("edit_type <> 'delete'").groupBy("define_name").agg(F.max("id").alias("id")).collect()}
    assert [tuple(r) for r in tables.edges.collect()] == [(ids["f"], ids["g"])]
    assert [(r.project_id, r.no_tests) for r in net.collect()] == [(1, False)]
    assert assist.count() <= 1


def test_a_repeated_round_gives_the_same(spark):
    nothing = R.seen_nothing(spark)
    seen = R.replace(nothing, defines=spark.createDataFrame([(p, f"src/{i}.py", "f", str(i), None, None) for p in (1, 2) for i in range(5)], DEF))
    once, again = (R.round_(R.empty(spark), seen, 1)[0] for _ in range(2))
    for a, b in ((once.log, again.log), (once.incidents, again.incidents), (once.messages, again.messages)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert R.round_(once, R.replace(seen, files=seen.defines.select("project_id", "file_path")), 2)[0].log.count() == 10
