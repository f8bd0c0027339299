"""Closed forms, hand-built histories and graphs, and properties."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronoweave.operators import association, chains, detectors, graph, intervals, maintenance, outcomes, ranks, reports
from chronoweave.operators.components import components

DET = "id long, project_id long, seq long, file_path string, define_name string, node_fingerprint string, fine_fingerprint string, content_hash string, edit_type string, created_at timestamp"


@pytest.fixture
def log(spark):
    """Events of one chain (or given ones) from (fingerprint, edit_type) pairs."""

    def make(*events, define="f", project=1, start=1):
        import datetime

        at = datetime.datetime(2024, 1, 1)
        rows = [(start + i, project, start + i, "src/a.py", define, fp, fp and fp + "f", f"h{start + i}", kind, at + datetime.timedelta(hours=i)) for i, (fp, kind) in enumerate(events)]
        return spark.createDataFrame(rows, DET)

    return make


def edges(spark, *pairs, a="from_det", b="to_det"):
    return spark.createDataFrame(list(pairs), f"{a} long, {b} long")


# graphs


def test_chain_distances(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 4))
    pairs = graph.closure(e, "to_det", "from_det")
    asked = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3), (3, 3)], "u long, v long")
    got = {(r.u, r.v): r.distance for r in graph.jaccard(pairs, asked).collect()}
    assert got == pytest.approx({(1, 2): 1 / 2, (1, 3): 2 / 3, (1, 4): 3 / 4, (2, 3): 1 / 3, (3, 3): 0.0})
    assert [(r.u, r.v, r.common) for r in graph.common_ancestors(pairs, asked.where("u = 2 or u = 3")).orderBy("u").collect()] == [(2, 3, 1), (3, 3, 2)]


def test_antichain_and_isolated_nodes(spark):
    e = edges(spark, (1, 2))
    pairs = graph.closure(e, "to_det", "from_det")
    asked = spark.createDataFrame([(7, 8), (2, 7)], "u long, v long")
    assert {r.distance for r in graph.jaccard(pairs, asked).collect()} == {1.0}
    nodes = spark.createDataFrame([(1,), (2,), (9,)], "node long")
    assert sorted(components(e, "from_det", "to_det", nodes).collect()) == [(1, 1), (2, 1), (9, 9)]


def test_closure_tolerates_cycles_and_empty_tables(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 3), (None, 4))
    got = {(r.node, r.ancestor): r.depth for r in graph.closure(e, "to_det", "from_det").collect()}
    assert got == {(a, b): (1 if (b % 3) + 1 == a else 2 if ((b + 1) % 3) + 1 == a else 3) for a in (1, 2, 3) for b in (1, 2, 3)}
    assert graph.cone_sizes(graph.closure(e, "to_det", "from_det")).count() == 3
    assert graph.closure(e.limit(0), "to_det", "from_det").count() == 0
    assert components(e.limit(0), "from_det", "to_det").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=25))
def test_closure_and_components_against_search(spark, pairs):
    e = spark.createDataFrame(list(pairs), "from_det long, to_det long")
    out, step = {n: {b for a, b in pairs if a == n and a != b} for n in range(13)}, {n: {b for a, b in pairs if a == n and a != b} for n in range(13)}
    for _ in range(13):
        out = {n: out[n] | {c for b in out[n] for c in step[b]} for n in out}
    got = {(r.node, r.ancestor) for r in graph.closure(e, "from_det", "to_det").collect()}
    assert got == {(n, m) for n in out for m in out[n]}
    root = list(range(13))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    touched = {n for p in pairs if p[0] != p[1] for n in p}
    assert {(r.node, r.component) for r in components(e, "from_det", "to_det").collect()} == {(n, root[n]) for n in touched}


def test_cones_and_ranks(spark):
    calls = edges(spark, (1, 2), (2, 3), (5, 3), (1, 3), (6, 1), a="caller", b="callee")
    seeds = spark.createDataFrame([(3,)], "node long")
    cone = graph.cone_with_depth(calls, seeds)
    assert sorted(cone.collect()) == [(1, 1), (2, 1), (5, 1), (6, 2)]
    rank = [(r.ranking, r.node, r.value) for r in graph.cone_ranks(cone, calls, 2).collect()]
    assert rank == [("delta", 6, 3), ("delta", 1, 2), ("indegree", 1, 1), ("indegree", 2, 1), ("distance", 1, 1), ("distance", 2, 1)]


def test_shared_successors_take_direct_predecessors_only(spark):
    e = edges(spark, (1, 3), (2, 3), (0, 1))
    assert sorted(graph.shared_successors(e, "from_det", "to_det").collect()) == [(1, 2), (2, 1)]


def test_acyclic_edges_break_cycles_by_order(spark):
    e = edges(spark, (1, 2), (2, 1), (2, 3), (3, 3))
    o = spark.createDataFrame([(n, n, n) for n in (1, 2, 3)], "node long, seq long, id long")
    assert sorted(graph.acyclic_edges(e, o).collect()) == [(1, 2), (2, 3)]


def test_chase_prefers_exact_names_and_ends_in_cycles(spark):
    redirects = spark.createDataFrame([("b", "f", "x", "g"), ("b", "*", "y", "*"), ("c", "h", "d", "h"), ("d", "h", "c", "h")], "barrel_module string, exported_name string, target_module string, target_name string")
    names = spark.createDataFrame([("b", "f"), ("b", "k"), ("c", "h"), ("z", "q")], "module string, name string")
    known = spark.createDataFrame([("x", "g"), ("y", "k"), ("y", "f")], "module string, name string")
    got = {(r.module, r.name): (r.to_module, r.to_name) for r in graph.chase(redirects, names, known).collect()}
    assert got == {("b", "f"): ("x", "g"), ("b", "k"): ("y", "k"), ("c", "h"): (None, None), ("z", "q"): (None, None)}


# chains


def test_loop_back_needs_a_gap_of_two(log):
    assert chains.loop_back(log(("a", "create"), ("a", "modify"))).count() == 0
    r = chains.loop_back(log(("a", "create"), ("b", "modify"), ("a", "modify"), ("b", "modify"))).first()
    assert (r.earlier_seq, r.later_seq, r.fingerprint) == (1, 3, "a")
    assert chains.latest_loops(log(("a", "create"), ("b", "modify"), ("a", "modify"))).count() == 1
    # events without fingerprint count as events
    assert chains.loop_back(log(("a", "create"), (None, "modify"), ("a", "modify"))).count() == 1


def test_stuck_needs_length_and_difference(log, spark):
    five = log(*[(x, "modify") for x in "abcde"])
    assert chains.stuck(five).count() == 1
    assert chains.stuck(log(*[(x, "modify") for x in "abcda"])).count() == 0
    assert chains.stuck(log(*[(x, "modify") for x in "abcd"])).count() == 0
    near = spark.createDataFrame([(4, 5, 0.1)], "u long, v long, distance double")
    assert chains.stuck(five, near).count() == 0


def test_states_and_differences(log):
    det = log(("a", "create"), ("b", "modify"), ("c", "delete")).unionByName(log(("x", "create"), define="g", start=4))
    assert [r.seq for r in chains.as_of(det, 2).collect()] == [2]
    assert chains.as_of(det, 3).count() == 0
    diff = {r.define_name: (r.change, r.before_hash, r.after_hash) for r in chains.snapshot_diff(det, 2, 4).collect()}
    assert diff == {"f": ("removed", "h2", None), "g": ("added", None, "h4")}
    assert chains.snapshot_diff(det, 1, 2).first().change == "changed"
    assert chains.snapshot_diff(det.limit(0), 1, 2).count() == 0


def test_head_streak_counts_the_last_run(log):
    det = log(("a", "create"), ("b", "modify")).unionByName(log(("x", "create"), ("y", "modify"), ("z", "delete"), define="g", start=3))
    r = chains.head_streak(det).first()
    assert (r.define_name, r.streak) == ("g", 3)


def test_global_rank_equals_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), x) for x in rng.sample(range(100_000), 500)]
    got = {(r.k, r.v): r.n for r in ranks.global_rank(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", "n", width=1000).collect()}
    for k in "ab":
        for n, v in enumerate(sorted(v for kk, v in rows if kk == k), 1):
            assert got[k, v] == n


# joins over order


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join_against_comparison(spark, width):
    rng = random.Random(width)
    points = [(rng.choice((1, 2)), rng.randrange(100)) for _ in range(80)]
    spans = [(i, rng.choice((1, 2)), low := rng.randrange(90), rng.choice((None, low + rng.randrange(20)))) for i in range(30)]
    got = intervals.within(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(spans, "i long, p long, low long, high long"), ["p"], "at", "low", "high", width)
    want = [(p, a, i) for p, a in points for i, q, low, high in spans if p == q and low < a and (high is None or a <= high)]
    assert sorted((r.p, r.at, r.i) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_nearest_against_comparison(spark, width):
    rng = random.Random(9)
    left = [(i, rng.choice((1, 2, 3)), rng.randrange(200)) for i in range(60)]
    right = [(rng.choice((1, 2)), rng.randrange(200), v) for v in range(25)]
    got = {r.i: r.v for r in intervals.nearest(spark.createDataFrame(left, "i long, p long, t long"), spark.createDataFrame(right, "p long, u long, v long"), ["p"], "t", "u", "v", width).collect()}
    for i, p, t in left:
        near = sorted((abs(u - t), u, v) for q, u, v in right if q == p)
        assert got[i] == (near[0][2] if near else None)


def test_nearest_is_linear_in_a_bin(spark):
    """No frame ends with the partition: Spark computes such a frame anew for each row. Also one bin that holds all rows."""
    left, right = spark.range(0, 30_000).selectExpr("1L AS p", "id AS i", "id * 3 AS t"), spark.range(0, 45_000).selectExpr("1L AS p", "id * 2 AS u", "id AS v")
    got = intervals.nearest(left, right, ["p"], "t", "u", "v", 10**6)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    assert got.where("v <> least(t div 2, 44999)").count() == 0 and got.count() == 30_000


@pytest.mark.parametrize("width", [1, 6, 1000])
def test_latest_against_comparison(spark, width):
    rng = random.Random(11)
    left = [(i, rng.choice((1, 2, 3)), rng.randrange(100)) for i in range(60)]
    right = [(rng.choice((1, 2)), rng.randrange(100), f"v{v}", v) for v in range(30)]
    got = {r.i: (r.v, r.v_at) for r in intervals.latest(spark.createDataFrame(left, "i long, p long, t long"), spark.createDataFrame(right, "p long, u long, v string, k long"), ["p"], "t", "u", "v", "k", width).collect()}
    for i, p, t in left:
        before = sorted((u, k, v) for q, u, v, k in right if q == p and u <= t)
        assert got[i] == ((before[-1][2], before[-1][0]) if before else (None, None))


def test_large_sides_are_not_broadcast(spark):
    """Joins that grow with the log, over files so small that Spark's estimate would have the driver broadcast them."""
    from chronoweave import adapters as A

    data = "/root/testdata/sf0.001"
    history = outcomes.case_history(A.test_cases(spark, data), A.test_runs(spark, data))
    events = A.edits(spark, data)
    cover = A.coverage(spark, data).withColumnRenamed("file_path", "define_key")
    cases = A.test_cases(spark, data).select("classname", "name")
    green = history.select("project_id", "classname", "name", "seq", "seq").toDF("project_id", "classname", "name", "red_seq", "green_seq")
    why = detectors.explained(cases.withColumn("define_key", cases["name"]), cover)
    for df in (history, cover, why, detectors.test_tampering(green, cases, why)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    found = intervals.within(events, events.selectExpr("user_id", "id - 1 AS low", "id AS high"), ["user_id"], "id", "low", "high")
    assert found._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") <= 1  # of the keys' largest values
    assert found.count() == events.count()


def test_longest_prefix(spark):
    files = spark.createDataFrame([("/a/b/c.py",), ("/a/x.py",), ("/ab/y.py",)], "path string")
    roots = spark.createDataFrame([("/a", 1), ("/a/b", 2)], "root_path string, project long")
    assert {r.path: r.project for r in intervals.longest_prefix(files, roots).collect()} == {"/a/b/c.py": 2, "/a/x.py": 1}


# outcomes and rules


def history(spark, text):
    """Results of one case: P, F, E or S for each run."""
    names = {"P": "passed", "F": "failed", "E": "error", "S": "skipped"}
    return spark.createDataFrame([(1, "C", "t", i, i * 10, names[c]) for i, c in enumerate(text, 1)], "project_id long, classname string, name string, test_run_id long, seq long, status string")


@pytest.mark.parametrize("text, red, green", [("PF", 1, 0), ("FP", 0, 1), ("PP", 0, 0), ("FF", 0, 0), ("P", 0, 0), ("PE", 1, 0), ("EP", 0, 1), ("PFS", 0, 0), ("SF", 0, 0)])
def test_turns(spark, text, red, green):
    h = history(spark, text)
    assert (outcomes.green_to_red(h).count(), outcomes.red_to_green(h).count()) == (red, green)


def test_last_red(spark):
    r = outcomes.last_red(history(spark, "FPFP")).first()
    assert (r.red_run, r.red_seq, r.green_seq) == (3, 30, 40)


def test_scope_forbids_first(spark):
    changed = spark.createDataFrame([(1, "src/a.py"), (1, "src/gen/b.py"), (1, "doc/c.md")], "project_id long, file_path string")
    got = {r.target_node: r.kind for r in detectors.task_scope_breach(changed, ["src/*"], ["*/gen/*"]).collect()}
    assert got == {"src/gen/b.py": "forbidden", "doc/c.md": "not_allowed"}


def test_tampering_needs_known_places(spark):
    green = spark.createDataFrame([(1, "C", "a", 1, 2), (1, "C", "b", None, 2), (1, "C", "c", 1, 2), (1, "C", "d", 1, 2)], "project_id long, classname string, name string, red_seq long, green_seq long")
    edited = spark.createDataFrame([("C", "a"), ("C", "b"), ("C", "c")], "classname string, name string")
    changes = spark.createDataFrame([("C", "c", True), ("C", "a", False)], "classname string, name string, explains boolean")
    assert [r.target_node for r in detectors.test_tampering(green, edited, changes).collect()] == ["C::a"]


def test_new_only_and_parse_skipped(spark):
    incidents = spark.createDataFrame([(1, "parse_skipped", "a.py", "open"), (1, "parse_skipped", "b.py", "resolved"), (1, "parse_skipped", "c.py", "open")], "project_id long, signal string, target_node string, state string")
    failed = spark.createDataFrame([(1, "a.py", False), (1, "b.py", False), (1, "c.py", True)], "project_id long, file_path string, ok boolean")
    new, done = detectors.parse_skipped(failed, incidents)
    assert [r.target_node for r in new.collect()] == ["b.py"] and [r.target_node for r in done.collect()] == ["c.py"]


# upkeep


def test_capture_follows_deletes(log, spark):
    det = log(("a", "create"), ("b", "delete")).unionByName(log(("x", "create"), define="g", start=3)).unionByName(log(("y", "create"), define="h", start=4))
    now = spark.createDataFrame([(1, "src/a.py", "f", "new"), (1, "src/a.py", "g", "h3"), (1, "src/a.py", "k", "k")], "project_id long, file_path string, define_name string, content_hash string")
    kinds = lambda **how: {r.define_name: r.edit_type for r in maintenance.capture(det, now, **how).collect()}
    assert kinds() == {"f": "create", "h": "delete", "k": "create"}
    assert kinds(repeat_deletes=True) == {"f": "modify", "h": "delete", "k": "create"}
    gone = maintenance.capture(det, now.limit(0))
    assert sorted((r.define_name, r.edit_type) for r in gone.collect()) == [("g", "delete"), ("h", "delete")]
    numbered = {r.define_name: r.seq for r in maintenance.numbered(gone, det, ["define_name"]).collect()}
    assert numbered == {"g": 5, "h": 6}


def test_upserts_and_retention(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v long, t string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w"), ("c", 3, "q")], old.schema)
    assert sorted(maintenance.upserted(old, new, ["k"], "v").collect()) == [("a", 2, "z"), ("b", 1, "y"), ("c", 3, "q")]
    assert sorted(maintenance.appended(old, new, ["k"], "v").collect()) == [("a", 1, "x"), ("b", 1, "y"), ("c", 1, "w")]
    assert sorted(maintenance.replaced(old, new, ["k"]).collect()) == [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w"), ("c", 3, "q")]
    rows = spark.createDataFrame([(k, i) for k in "ab" for i in range(5)], "k string, i long")
    assert sorted((r.k, r.i) for r in maintenance.kept(rows, ["k"], "i", 2, width=2).collect()) == [("a", 3), ("a", 4), ("b", 3), ("b", 4)]


# names


def test_similar_names(spark):
    asked = spark.createDataFrame([("load",), ("validate_tok",), ("zzz",)], "text string")
    names = spark.createDataFrame([("load",), ("lead",), ("loads",), ("reload_all",), ("validate_token",), ("unload",)], "name string")
    got = {}
    for r in association.similar_names(asked, names).collect():
        got.setdefault(r.text, []).append((r.distance, r.name))
    assert {k: sorted(v) for k, v in got.items()} == {"load": [(1, "lead"), (1, "loads"), (2, "unload")], "validate_tok": [(2, "validate_token")]}


def test_association_takes_the_first_tier(spark):
    defines = spark.createDataFrame([("1", "src/a.py", "run"), ("2", "src/auth.py", "login"), ("3", "src/zip.py", "pack")], "define_key string, file_path string, define_name string")
    coverage = spark.createDataFrame([("run", "tests.test_x", "test_all")], "define_name string, classname string, name string")
    cases = spark.createDataFrame([("tests.test_x", "test_all"), ("tests.test_y", "test_run"), ("tests.test_auth", "test_login"), ("tests.test_zip", "test_it")], "classname string, name string")
    got = {(r.define_key, r.classname, r.tier) for r in association.associated_cases(defines, coverage, cases).collect()}
    assert got == {("1", "tests.test_x", 1), ("2", "tests.test_auth", 2), ("3", "tests.test_zip", 3)}


def test_prices_take_the_longest_prefix(spark):
    price = spark.createDataFrame([("m", 1.0, 0.0, 1.0), ("m-large", 2.0, 0.0, 2.0)], "model string, input double, cache double, output double")
    models = spark.createDataFrame([("m-large-2024",), ("m-small",), ("other",)], "model string")
    assert {r.model: r.priced_as for r in reports.priced(models, price).collect()} == {"m-large-2024": "m-large", "m-small": "m"}


def test_current_edges_and_suspects(spark):
    calls = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("a", "gone")], "caller string, callee string")
    current = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "fqn string, id long")
    assert sorted(tuple(r) for r in graph.current_edges(calls, current).collect()) == [(20, 10), (30, 10)]
    stacks = spark.createDataFrame([(i, [f"f{i}", "all"]) for i in range(6)], "id long, stack_fqns array<string>")
    cone = spark.createDataFrame([("f5",), ("f2",), ("all",), ("z",)], "node string")
    assert sorted(r.node for r in graph.suspects(cone, stacks).collect()) == ["all", "f5"]


def test_edited_cases(spark):
    cases = spark.createDataFrame([("tests.a.TestK", "test_x[1]"), ("tests.a", "test_y"), ("tests.a.TestL", "test_z"), ("tests.b", "test_w")], "classname string, name string")
    edited = spark.createDataFrame([("TestK.test_x",), ("test_y",), ("TestL",), ("Other.test_w",)], "define_name string")
    assert sorted(r.name for r in association.edited_cases(cases, edited).collect()) == ["test_x[1]", "test_y", "test_z"]


def test_chase_follows_chains_of_any_length_and_ends_in_cycles(spark):
    steps = [(f"m{i}", "a", f"m{i + 1}", "a") for i in range(20)] + [("c0", "*", "c1", None), ("c1", "*", "c0", None)]
    redirects = spark.createDataFrame(steps, "barrel_module string, exported_name string, target_module string, target_name string")
    names = spark.createDataFrame([("m0", "a"), ("c0", "a")], "module string, name string")
    known = spark.createDataFrame([("m20", "a")], "module string, name string")
    found = {r.module: (r.to_module, r.to_name) for r in graph.chase(redirects, names, known).collect()}
    assert found == {"m0": ("m20", "a"), "c0": (None, None)}


def test_lateral_structure_has_ancestry_and_component_size(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (9, 2), (9, 3), (2, 4)], "from_det long, to_det long")
    calls = spark.createDataFrame([(2, 3), (2, 4), (2, 7)], "caller long, callee long")
    targets = spark.createDataFrame([(2,), (7,)], "node long")
    got = {r.node: (r.shared_ancestry and [tuple(x) for x in r.shared_ancestry], r.component_size) for r in detectors.lateral_structure(targets, calls, edges).collect()}
    assert got == {2: ([(3, 2), (4, 2)], 5), 7: (None, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_closure_depths_against_search(spark, seed):
    """Least depths from all nodes and from seeds, on graphs with cycles, hubs and long paths; with and without a bound."""
    rng = random.Random(seed)
    links = {(i, i + 1) for i in range(20)} | {(rng.randrange(40), rng.randrange(40)) for _ in range(30)} | {(50, i) for i in range(10)}
    e = spark.createDataFrame(sorted(links), "a long, b long")
    want = {}
    for start in {a for a, _ in links}:
        level, depth, seen = {start}, 0, set()
        while level:
            depth += 1
            level = {b for a, b in links if a in level and a != b} - seen
            seen |= level
            want |= {(start, b): depth for b in level}
    found = lambda **how: {(r.node, r.ancestor): r.depth for r in graph.closure(e, "a", "b", **how).collect()}
    assert found() == want
    seeds = spark.createDataFrame([(0,), (50,), (33,), (99,)], "node long")
    assert found(seeds=seeds) == {k: d for k, d in want.items() if k[0] in (0, 50, 33)}
    for most in (1, 2, 3, 7):
        assert found(most=most) == {k: d for k, d in want.items() if d <= most}
        assert found(seeds=seeds, most=most) == {k: d for k, d in want.items() if k[0] in (0, 50, 33) and d <= most}


def test_long_spans_touch_two_bins(spark):
    """Spans of very different lengths, with a narrow width: all pairs, and no more rows than two for each span."""
    rng = random.Random(5)
    points = [(1, rng.randrange(10**7)) for _ in range(300)]
    spans = [(1, i, low, low + rng.choice([0, 3, 100, 10**4, 5 * 10**6])) for i, low in enumerate(rng.randrange(10**7) for _ in range(60))] + [(1, 99, 5 * 10**6, None)]
    p = spark.createDataFrame(points, "k long, at long")
    s = spark.createDataFrame(spans, "k long, i long, low long, high long")
    top = max(at for _, at in points)
    want = sorted((at, i) for _, at in points for _, i, low, high in spans if low < at <= (top if high is None else high))
    assert sorted((r.at, r.i) for r in intervals.within(p, s, ["k"], "at", "low", "high", width=16).collect()) == want
    assert intervals.within(p, s.limit(0), ["k"], "at", "low", "high").count() == 0
