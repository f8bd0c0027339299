"""Whether the condition of an open incident still holds in a round (2.K), and what its end is called."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.idents import glob_matches, out_of_detection

from .chains import CHAIN, STREAK_AGENT, head_streak, latest_loops
from .outcomes import CASE, FAILING
from .registers import detail

# Why an incident of a signal ended.
REASONS = {
    "stuck_region": "stable_region", "debug_loop": "test_passed", "regression": "test_recovered", "test_tampering": "really_fixed", "define_loop": "no_more_equiv",
    "boundary_breach": "back_in_scope", "task_scope_breach": "back_in_scope", "dangling_reference": "defined_or_removed",
}


def resolved_by(signal: Column) -> Column:
    out = F.lit("resolved")
    for name, reason in REASONS.items():
        out = F.when(signal == name, reason).otherwise(out)
    return out


def recurred(incidents: DataFrame, affected: DataFrame, det: DataFrame, history: DataFrame, breaches: DataFrame, scopes: DataFrame, dangling: DataFrame) -> DataFrame:
    """(incident, recurred) for each of incidents (incident, project_id, signal, target_node, details).

    affected: (project_id, file_path, define_name) changed in this round; history: case outcomes; breaches: (project_id,
    path) changed outside the roots; scopes: active ones (project_id, allowed, forbidden); dangling: calls still
    unresolved (project_id, file_path, caller_define, callee_text). A debug loop lasts while one of its cases failed in
    its last run, a regression while its case did; tampering while its case fails, or passes without a production change
    in this round; a stuck region recurs with each change of its define, a define loop if that change comes back to an
    earlier form or the define is edited five times in a row; breaches recur as long as they are made, and dangling calls
    while their caller lives and they lead nowhere. Files that cannot be parsed stay until they can. Each signal is one
    equi join on its own incidents.
    """
    of = lambda *names: incidents.where(F.col("signal").isin(*names))
    yes = F.lit(True).alias("yes")
    last = history.groupBy(*CASE).agg(F.max_by(F.col("status").isin(*FAILING), "test_run_id").alias("red"))
    cases = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json("details"), "$.test_cases", "variant")), "array<string>")
    named = lambda rows: rows.where(F.coalesce("classname", F.lit("")) != "").where(F.coalesce("name", F.lit("")) != "").join(last, CASE)
    loops = of("debug_loop").withColumn("case", F.explode(cases)).where(F.instr("case", "::") > 0)
    loops = loops.withColumn("classname", F.substring_index("case", "::", 1)).withColumn("name", F.expr("substring(case, instr(case, '::') + 2)"))
    found = [named(loops).where("red").select("incident", yes)]
    tested = of("regression", "test_tampering").withColumn("classname", detail(F.col("details"), "classname")).withColumn("name", detail(F.col("details"), "name"))
    worked = affected.where(~out_of_detection(F.col("file_path"))).select("project_id", F.lit(True).alias("worked")).distinct()
    tested = named(tested).join(worked, "project_id", "left")
    found.append(tested.where("red or (signal = 'test_tampering' and worked is null)").select("incident", yes))

    key = F.concat_ws("::", "file_path", "define_name").alias("target_node")
    touched = affected.select("project_id", key).distinct()
    found.append(of("stuck_region").join(touched, ["project_id", "target_node"], "left_semi").select("incident", yes))
    back = latest_loops(det).select("project_id", key).unionByName(head_streak(det).where(F.col("streak") >= STREAK_AGENT).select("project_id", key)).distinct()
    found.append(of("define_loop").join(touched, ["project_id", "target_node"], "left_semi").join(back, ["project_id", "target_node"], "left_semi").select("incident", yes))

    found.append(of("boundary_breach").join(breaches.select("project_id", F.col("path").alias("target_node")).distinct(), ["project_id", "target_node"], "left_semi").select("incident", yes))
    files = affected.select("project_id", F.col("file_path").alias("target_node")).distinct()
    scoped = of("task_scope_breach").join(files, ["project_id", "target_node"], "left_semi").join(scopes, "project_id")
    hit = lambda globs: F.coalesce(F.exists(globs, lambda g: glob_matches(F.col("target_node"), g)), F.lit(False))
    found.append(scoped.where(hit(F.col("forbidden")) | ~hit(F.col("allowed"))).select("incident", yes))

    alive = det.groupBy(*CHAIN).agg(F.max_by("edit_type", "seq").alias("t")).where("t <> 'delete'").select("project_id", "file_path", F.col("define_name").alias("caller_define"))
    calls = [F.col(c) for c in ("project_id", "file_path", "caller_define", "callee_text")]
    left = dangling.select(*calls).distinct().join(alive, ["project_id", "file_path", "caller_define"], "left_semi")
    open_calls = of("dangling_reference").select("incident", "project_id", *[detail(F.col("details"), c).alias(c) for c in ("file_path", "caller_define", "callee_text")])
    found.append(open_calls.join(left, ["project_id", "file_path", "caller_define", "callee_text"], "left_semi").select("incident", yes))
    found.append(of("parse_skipped").select("incident", yes))

    every = reduce(DataFrame.unionByName, found).distinct()
    return incidents.select("incident").join(every, "incident", "left").select("incident", F.coalesce("yes", F.lit(False)).alias("recurred"))
