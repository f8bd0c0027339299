"""One round of bringing all tables up to date (I01): what changed, what calls what, which rules fire, who is told.

A round is a pure function of the tables before it and of what was seen, so it can run as a batch job, or as the stage of a
stream (streaming.rounds), where a round that failed is repeated whole.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.idents import is_test_file, out_of_detection
from chronoweave.scratch import stored

from . import chains, detectors, escalation, graph, maintenance, outcomes, recurrence, registers, reports
from .association import edited_cases
from .chains import CHAIN

INCIDENT = "incident long, project_id long, signal string, target_node string, details string, direct boolean, level string, state string, count int, stable int, agent int, user int, round long"
MESSAGE = "incident long, channel string, kind string, message string, round long"
LOG = "id long, project_id long, seq long, file_path string, define_name string, content_hash string, node_fingerprint string, fine_fingerprint string, edit_type string, round long"


@dataclass
class Tables:
    """What rounds leave behind: the log, calls between defines, edges between current versions, incidents, messages."""

    log: DataFrame
    calls: DataFrame
    edges: DataFrame
    incidents: DataFrame
    messages: DataFrame


@dataclass
class Seen:
    """What a round looks at. defines: CHAIN, content_hash, node_fingerprint, fine_fingerprint of the files read; files:
    (project_id, file_path) read, or None for all; calls: (project_id, source_file, caller, callee) of these files by
    file::define; parse: (project_id, file_path, ok); cases and runs: all results so far; coverage: (project_id, file_path,
    define_name, classname, name); scopes: (project_id, allowed, forbidden); breaches: (project_id, path) outside the roots;
    levels: (project_id, level); commits: (project_id, seq); dangling: unresolved calls (project_id, file_path,
    caller_define, callee_text, det_id)."""

    defines: DataFrame
    files: DataFrame | None
    calls: DataFrame
    parse: DataFrame
    cases: DataFrame
    runs: DataFrame
    coverage: DataFrame
    scopes: DataFrame
    breaches: DataFrame
    levels: DataFrame
    commits: DataFrame
    dangling: DataFrame


def empty(spark) -> Tables:
    make = lambda schema: spark.createDataFrame([], schema)
    return Tables(make(LOG), make("project_id long, source_file string, caller string, callee string"), make("from_det long, to_det long"), make(INCIDENT), make(MESSAGE))


def changes(before: Tables, seen: Seen, number: int) -> DataFrame:
    """Phase 1: the events of this round, numbered after those before."""
    events = maintenance.capture(before.log, seen.defines, seen.files)
    prints = seen.defines.select(*CHAIN, "node_fingerprint", "fine_fingerprint")
    new = maintenance.numbered(events, before.log, ["file_path", "define_name"]).join(prints, CHAIN, "left")
    return new.withColumn("id", F.col("project_id") * (1 << 40) + F.col("seq")).withColumn("round", F.lit(number).cast("long")).select(*before.log.columns)


def linked(before: Tables, log: DataFrame, seen: Seen) -> tuple[DataFrame, DataFrame]:
    """Phases 1.5 and 2: calls of the files read give way to what they are now; edges follow from the current versions."""
    calls = maintenance.replaced(before.calls, seen.calls, ["project_id", "source_file"])
    tag = lambda name: F.concat_ws("|", F.col("project_id").cast("string"), name)  # noqa: E731  # projects share no define
    now = chains.current_version(log).where("edit_type <> 'delete'").select(tag(F.concat_ws("::", "file_path", "define_name")).alias("fqn"), "id", "seq")
    edges = graph.current_edges(calls.select(tag(F.col("caller")).alias("caller"), tag(F.col("callee")).alias("callee")), now)
    order = log.select(F.col("id").alias("node"), "seq", "id")
    return calls, graph.acyclic_edges(edges, order)


def candidates(log: DataFrame, affected: DataFrame, incidents: DataFrame, seen: Seen) -> DataFrame:
    """All rules in their order: (project_id, signal, target_node, details, direct), without those that are open."""
    key = F.concat_ws("::", "file_path", "define_name")
    history = stored(outcomes.case_history(seen.cases, seen.runs))
    covers = seen.coverage.select("project_id", *CHAIN[1:], key.alias("define_key"), "classname", "name")
    touched = affected.select(*CHAIN).distinct()
    still = stored(chains.stuck(log).join(touched, CHAIN, "left_semi"))
    span = log.groupBy("project_id", key.alias("define_key")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    tag = lambda df: df.withColumn("define_key", F.concat_ws("|", F.col("project_id").cast("string"), "define_key"))
    failing = outcomes.persistent_failure(history, tag(covers).select("define_key", "classname", "name"), tag(span)).where("failing")
    failing = failing.select("define_key").join(tag(log.select(*CHAIN, key.alias("define_key")).distinct()), "define_key")
    named = covers.select("project_id", F.col("define_key").alias("target_node"), F.concat_ws("::", "classname", "name").alias("c")).groupBy("project_id", "target_node").agg(F.to_json(F.struct(F.sort_array(F.collect_set("c")).alias("test_cases"))).alias("details"))
    debug = stored(detectors.debug_loop(still, failing))
    found = [debug.join(named, ["project_id", "target_node"], "left"), detectors.stuck_region(still, debug)]
    summary = chains.define_summary(log).join(touched, CHAIN, "left_semi")
    found.append(detectors.token_waste(summary, incidents.where("state <> 'resolved'"), incidents))
    evolution = touched.limit(0).select(*CHAIN, F.lit("").alias("evolution"))
    loops = detectors.define_loop(log, evolution, still, debug).join(touched.select("project_id", key.alias("target_node")), ["project_id", "target_node"], "left_semi")
    found.append(loops.select("project_id", "signal", "target_node", "direct"))
    found.append(detectors.boundary_breach(seen.breaches.select("project_id", "path")))
    scoped = affected.select("project_id", "file_path").distinct().join(seen.scopes, "project_id")
    hit = lambda globs: F.coalesce(F.exists(globs, lambda g: recurrence.glob_matches(F.col("file_path"), g)), F.lit(False))
    found.append(scoped.where(hit(F.col("forbidden")) | ~hit(F.col("allowed"))).select("project_id", F.lit("task_scope_breach").alias("signal"), F.col("file_path").alias("target_node")))
    case = lambda df: df.withColumn("details", F.to_json(F.struct(F.substring_index("target_node", "::", 1).alias("classname"), F.expr("substring(target_node, instr(target_node, '::') + 2)").alias("name"))))
    red = outcomes.green_to_red(history).select("classname", "name")
    found.append(case(detectors.regression(red, covers.select("define_key", "classname", "name"), affected)))
    green = outcomes.last_red(history)
    edited = edited_cases(green.select("classname", "name"), affected.where(is_test_file(F.col("file_path"))))
    windows = green.select(F.concat_ws("::", "classname", "name").alias("window_id"), "project_id", F.col("red_seq").alias("low"), F.col("green_seq").alias("high")).where("low is not null and high is not null")
    worked = outcomes.production_changes(windows, log, is_test_file(F.col("file_path")) | out_of_detection(F.col("file_path")))
    worked = worked.select(F.substring_index("window_id", "::", 1).alias("classname"), F.expr("substring(window_id, instr(window_id, '::') + 2)").alias("name"), key.alias("define_key"))
    found.append(case(detectors.test_tampering(green, edited, detectors.explained(worked, covers))))
    found.append(detectors.dangling_reference(seen.dangling).select("project_id", "signal", "target_node"))
    found.append(detectors.parse_skipped(seen.parse, incidents)[0])
    full = [df.withColumns({c: F.lit(None).cast(t) for c, t in (("details", "string"), ("direct", "boolean")) if c not in df.columns}) for df in found]
    every = reduce(DataFrame.unionByName, [df.select("project_id", "signal", "target_node", "details", F.coalesce("direct", F.lit(False)).alias("direct")) for df in full])
    return detectors.new_only(every.dropDuplicates(["project_id", "signal", "target_node"]), incidents)


def advanced(before: Tables, log: DataFrame, affected: DataFrame, found: DataFrame, seen: Seen, number: int) -> DataFrame:
    """Incidents after the round: open ones take a step of the state machine, new ones their first."""
    level = lambda df: df.drop("level").join(seen.levels.select("project_id", "level"), "project_id", "left").fillna("medium", ["level"])
    done = before.incidents.where("state = 'resolved'")
    open_ = level(before.incidents.where("state <> 'resolved'"))
    history = outcomes.case_history(seen.cases, seen.runs)
    again = recurrence.recurred(open_, affected, log, history, seen.breaches, seen.scopes, seen.dangling)
    parsed = seen.parse.where("ok").select("project_id", F.lit("parse_skipped").alias("signal"), F.col("file_path").alias("target_node"), F.lit(True).alias("fine")).distinct()
    state = F.struct("state", "count", "stable", "agent", "user")
    rows = open_.join(again, "incident").join(parsed, ["project_id", "signal", "target_node"], "left")
    rows = rows.withColumn("s", escalation.step(state, F.col("recurred"), F.col("signal"), F.col("level"), F.col("direct")))
    # what can be read again is over, whatever the state machine would say
    rows = rows.withColumn("s", F.when(F.col("fine"), F.col("s").withField("state", F.lit("resolved"))).otherwise(F.col("s")))
    first = F.xxhash64(F.lit(number), "project_id", "signal", "target_node")
    new = level(found.withColumn("incident", first)).withColumn("s", escalation.step(escalation.opened(), F.lit(False), F.col("signal"), F.col("level"), F.col("direct")))
    both = rows.select("incident", "project_id", "signal", "target_node", "details", "direct", "level", "s", "round").unionByName(new.withColumn("round", F.lit(number).cast("long")).select("incident", "project_id", "signal", "target_node", "details", "direct", "level", "s", "round"))
    names = before.incidents.columns
    return done.select(*names).unionByName(both.select(*[F.col(f"s.{c}").alias(c) if c in ("state", "count", "stable", "agent", "user") else F.col(c) for c in names]))


def round_(before: Tables, seen: Seen, number: int) -> tuple[Tables, DataFrame, DataFrame]:
    """(tables after the round, warnings of the safety net by project, one suggestion for each project at most)."""
    events = stored(changes(before, seen, number))
    log = stored(before.log.unionByName(events))
    affected = events.select(*CHAIN)
    calls, edges = linked(before, log, seen)
    found = stored(candidates(log, affected, before.incidents, seen))
    incidents = stored(advanced(before, log, affected, found, seen, number))
    counts = lambda df: df.select("incident", "signal", "target_node", "agent", "user")
    told = registers.deliveries(counts(before.incidents), counts(incidents)).withColumn("round", F.lit(number).cast("long"))
    after = Tables(log, stored(calls), stored(edges), incidents, stored(before.messages.unionByName(told.select(*before.messages.columns))))
    net = reports.safety_net(log, seen.runs.select("project_id"), seen.commits)
    fan = after.calls.groupBy("project_id", "callee").agg(F.count_distinct("caller").alias("callers"))
    callers = fan.select("project_id", F.substring_index("callee", "::", 1).alias("file_path"), F.substring_index("callee", "::", -1).alias("define_name"), "callers")
    ran = outcomes.case_history(seen.cases, seen.runs).select("project_id", F.concat_ws("::", "classname", "name").alias("test_case"), "seq")
    tests = seen.coverage.select(*CHAIN, F.concat_ws("::", "classname", "name").alias("test_case"))
    since = seen.commits.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first().s
    return after, net, reports.inline_assist(log, callers, tests, ran, since)


def seen_nothing(spark) -> Seen:
    """A round that saw nothing; replace() what it did see."""
    make = lambda schema: spark.createDataFrame([], schema)
    chain = "project_id long, file_path string, define_name string"
    return Seen(
        make(f"{chain}, content_hash string, node_fingerprint string, fine_fingerprint string"), None, make("project_id long, source_file string, caller string, callee string"),
        make("project_id long, file_path string, ok boolean"), make("test_run_id long, classname string, name string, status string"), make("id long, project_id long, seq long"),
        make(f"{chain}, classname string, name string"), make("project_id long, allowed array<string>, forbidden array<string>"), make("project_id long, path string"),
        make("project_id long, level string"), make("project_id long, seq long"), make("project_id long, file_path string, caller_define string, callee_text string, det_id long"),
    )


__all__ = ["Seen", "Tables", "advanced", "candidates", "changes", "empty", "linked", "replace", "round_", "seen_nothing"]
