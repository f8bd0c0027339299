"""Rules that turn changes and outcomes into incidents.

Each gives candidates (project_id, signal, target_node, …). new_only() drops those whose incident is still open. Order
matters: debug loops before stuck regions before waste before define loops, since each looks at the ones before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.idents import glob_regex, out_of_detection

from .chains import CHAIN, STREAK_AGENT, STREAK_USER, head_streak, loop_back
from .ranks import as_large

WASTE_ROUNDS, WASTE_INCIDENTS = 15, 2


def _target() -> Column:
    return F.concat_ws("::", "file_path", "define_name")


def _signal(rows: DataFrame, name: str, target: Column | None = None, *more: Column | str) -> DataFrame:
    return rows.select("project_id", F.lit(name).alias("signal"), (_target() if target is None else target).alias("target_node"), *more)


def new_only(candidates: DataFrame, incidents: DataFrame) -> DataFrame:
    """Candidates without an unresolved incident of the same signal on the same target."""
    open_ = incidents.where("state <> 'resolved'").select("project_id", "signal", "target_node").distinct()
    return candidates.join(open_, ["project_id", "signal", "target_node"], "left_anti")


def debug_loop(stuck: DataFrame, failing: DataFrame) -> DataFrame:
    """Stuck chains whose associated tests fail through the whole edit window (failing: CHAIN)."""
    rows = stuck.where(~out_of_detection(F.col("file_path"))).join(failing.select(*CHAIN), CHAIN, "left_semi")
    return _signal(rows, "debug_loop")


def stuck_region(stuck: DataFrame, debug: DataFrame) -> DataFrame:
    """Stuck chains without a debug loop on the same target."""
    rows = _signal(stuck.where(~out_of_detection(F.col("file_path"))), "stuck_region")
    return rows.join(debug.select("project_id", "target_node"), ["project_id", "target_node"], "left_anti")


def token_waste(summary: DataFrame, open_now: DataFrame, history: DataFrame) -> DataFrame:
    """Chains of 15 versions or more with an open stuck or debug incident and two in all. Paths are not excluded."""
    kinds = ["stuck_region", "debug_loop"]
    many = history.where(F.col("signal").isin(kinds)).groupBy("project_id", "target_node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WASTE_INCIDENTS)
    rows = _signal(summary.where(F.col("version_count") >= WASTE_ROUNDS), "token_waste", _target(), F.col("version_count").alias("rounds"))
    now = open_now.where(F.col("signal").isin(kinds)).select("project_id", "target_node").distinct()
    return rows.join(now, ["project_id", "target_node"], "left_semi").join(many, ["project_id", "target_node"], "left_semi")


def define_loop(det: DataFrame, evolution: DataFrame, stuck: DataFrame, debug: DataFrame) -> DataFrame:
    """Chains that return to an earlier form (a), or are edited five times in a row (b).

    b alone is left to the stuck and debug rules where they hold; without a, an error that went away (evolution: CHAIN,
    evolution) ends it. From eight in a row on the user is told at once.
    """
    a = loop_back(det).select(*CHAIN, F.lit(True).alias("a"))
    b = head_streak(det).where(F.col("streak") >= STREAK_AGENT).select(*CHAIN, "streak")
    rows = a.join(b, CHAIN, "full_outer").where(~out_of_detection(F.col("file_path")))
    rows = rows.join(stuck.select(*CHAIN, F.lit(True).alias("is_stuck")), CHAIN, "left").join(evolution, CHAIN, "left")
    rows = rows.withColumn("target_node", _target()).join(debug.select("project_id", "target_node", F.lit(True).alias("is_debug")), ["project_id", "target_node"], "left")
    keep = F.col("a").isNotNull() | (F.col("is_stuck").isNull() & F.col("is_debug").isNull() & F.coalesce(F.col("evolution") != "resolved", F.lit(True)))
    direct = F.coalesce(F.col("streak") >= STREAK_USER, F.lit(False)).alias("direct")
    return rows.where(keep).select("project_id", F.lit("define_loop").alias("signal"), "target_node", F.when(F.col("a").isNotNull(), "return").otherwise("streak").alias("mechanism"), direct)


def boundary_breach(outside: DataFrame) -> DataFrame:
    """Changed paths outside the project's roots (project_id, path)."""
    return _signal(outside.distinct(), "boundary_breach", F.col("path"))


def task_scope_breach(changed: DataFrame, allowed: list[str], forbidden: list[str]) -> DataFrame:
    """Changed files (project_id, file_path) that match a forbidden pattern, or no allowed one; forbidden wins."""
    bad, good = (F.col("file_path").rlike("|".join(map(glob_regex, g))) if g else F.lit(False) for g in (forbidden, allowed))
    kind = F.when(bad, "forbidden").when(~good, "not_allowed")
    return _signal(changed.distinct().withColumn("kind", kind).where("kind is not null"), "task_scope_breach", F.col("file_path"), "kind")


def regression(turned_red: DataFrame, association: DataFrame, changed: DataFrame) -> DataFrame:
    """Cases that turned red and are associated with a changed production define.

    association: (define_key, classname, name, tier); changed: (project_id, file_path, define_name).
    """
    key = changed.where(~out_of_detection(F.col("file_path"))).select("project_id", _target().alias("define_key")).distinct()
    rows = turned_red.select("classname", "name").join(association, ["classname", "name"]).join(key, "define_key")
    return _signal(rows, "regression", F.concat_ws("::", "classname", "name")).distinct()


def test_tampering(turned_green: DataFrame, edited_tests: DataFrame, changes: DataFrame) -> DataFrame:
    """Cases that turned green after their test was edited, without a change of production code since the last red
    that could explain it.

    turned_green: (project_id, classname, name, red_seq, green_seq), null seqs never fire; edited_tests: (classname, name);
    changes: (classname, name, explains) of production defines changed in (red, green], where explains is false for a
    define whose precise coverage is known and does not hold the case.
    """
    rows = turned_green.where("red_seq is not null and green_seq is not null").join(as_large(edited_tests.distinct()), ["classname", "name"], "left_semi")
    why = changes.where("explains").select("classname", "name").distinct()
    return _signal(rows.join(as_large(why), ["classname", "name"], "left_anti"), "test_tampering", F.concat_ws("::", "classname", "name"))


def explained(changes: DataFrame, coverage: DataFrame) -> DataFrame:
    """(classname, name, explains) of production defines changed since a case's last red (classname, name,
    define_key): a define explains a green case unless its coverage (define_key, classname, name) is known and does not
    hold the case."""
    known = coverage.select("define_key", F.lit(True).alias("_known")).distinct()
    held = coverage.select("define_key", "classname", "name", F.lit(True).alias("_held")).distinct()
    rows = changes.join(as_large(known), "define_key", "left").join(as_large(held), ["define_key", "classname", "name"], "left")
    return rows.select("classname", "name", (F.col("_known").isNull() | F.col("_held").isNotNull()).alias("explains")).distinct()


def dangling_reference(observations: DataFrame, least: int = 2) -> DataFrame:
    """Unresolved calls seen in at least two different versions of their caller."""
    by = ["project_id", "file_path", "caller_define", "callee_text"]
    rows = observations.groupBy(*by).agg(F.count_distinct("det_id").alias("seen")).where(F.col("seen") >= least)
    return _signal(rows, "dangling_reference", F.concat_ws("::", "file_path", "caller_define", "callee_text"), "seen")


def parse_skipped(failed: DataFrame, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new incidents for files that cannot be parsed, open incidents of files that can be again).

    failed: (project_id, file_path, ok).
    """
    new = new_only(_signal(failed.where("not ok").distinct(), "parse_skipped", F.col("file_path")), incidents)
    again = failed.where("ok").select("project_id", F.col("file_path").alias("target_node")).distinct()
    done = incidents.where("signal = 'parse_skipped' and state <> 'resolved'").join(again, ["project_id", "target_node"], "left_semi")
    return new, done


def toolchain_missing(changed: DataFrame, has_toolchain: bool) -> DataFrame:
    """TypeScript files of a project without its compiler."""
    rows = changed.where(F.col("file_path").rlike(r"\.tsx?$")).distinct()
    return _signal(rows if not has_toolchain else rows.limit(0), "ts_toolchain_missing", F.col("file_path"))


def lateral_context(targets: DataFrame, calls: DataFrame, edges: DataFrame, changed_seq: DataFrame, low: int, high: int) -> DataFrame:
    """C26 and J12's neighbours: for each target node its callees changed in the window, and peers that share a successor.

    targets: (node); calls: (caller, callee); edges: (from_det, to_det); changed_seq: (node, seq) of last changes.
    """
    from .graph import shared_successors

    inside = changed_seq.where((F.col("seq") > low) & (F.col("seq") <= high)).select("node").distinct()
    called = targets.join(calls.select(F.col("caller").alias("node"), "callee").distinct(), "node").join(inside.withColumnRenamed("node", "callee"), "callee")
    called = called.groupBy("node").agg(F.count(F.lit(1)).alias("callees_changed"))
    peers = shared_successors(edges, "from_det", "to_det", targets)
    moved = peers.join(inside.withColumnRenamed("node", "peer").withColumn("moved", F.lit(1)), "peer", "left")
    peers = moved.groupBy("node").agg(F.count(F.lit(1)).alias("peers"), F.sum(F.coalesce("moved", F.lit(0))).alias("peers_changed"))
    return targets.join(called, "node", "left").join(peers, "node", "left").fillna(0, ["callees_changed", "peers", "peers_changed"])


def lateral_structure(targets: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """J12's other dimensions: (node, shared_ancestry, component_size) of each target. shared_ancestry holds (callee,
    omega) of the callees with an ancestor in common, most first; a node without edges is a component of its own."""
    from .components import components
    from .graph import closure, common_ancestors

    asked = targets.join(calls.select(F.col("caller").alias("node"), "callee").distinct(), "node").select(F.col("node").alias("u"), F.col("callee").alias("v"))
    seeds = asked.select(F.col("u").alias("node")).unionByName(asked.select(F.col("v").alias("node")))
    omega = common_ancestors(closure(edges, "to_det", "from_det", seeds).where("node <> ancestor"), asked)
    order = F.array_sort(F.collect_list(F.struct((-F.col("common")).alias("less"), F.col("v").alias("callee"))))
    shared = omega.groupBy(F.col("u").alias("node")).agg(F.transform(order, lambda x: F.struct(x["callee"].alias("callee"), (-x["less"]).alias("omega"))).alias("shared_ancestry"))
    of = components(edges, "from_det", "to_det", targets)
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    return targets.join(shared, "node", "left").join(of.join(sizes, "component").select("node", "component_size"), "node", "left")


def direction_note(rows: DataFrame) -> DataFrame:
    """The first of six hints that holds, for rows with failing, callees_changed, peers_changed, peers, cone."""
    note = (
        F.when(F.col("failing") & (F.col("callees_changed") > 0), "tests fail and callees changed: look at the callees")
        .when(F.col("failing"), "tests fail through all edits: look at the test's expectation")
        .when(F.col("callees_changed") > 0, "callees changed: look at what they return now")
        .when(F.col("peers_changed") > 0, "defines with the same users changed: look at the shared contract")
        .when(F.col("peers") > 0, "others serve the same users: compare them")
        .otherwise("no structural lead: narrow the change")
    )
    return rows.withColumn("note", note)


def all_signals(*candidates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select("project_id", "signal", "target_node") for c in candidates])
