"""State that commands and hook events build up: scopes, levels, warnings, sessions, snapshots, messages.

Commands are an append-only log like changes; the state is its last word on each key, so nothing is updated in place and
any state can be had as of any place in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.console import git_kind
from chronoweave.functions.messages import message

from .escalation import OPENED_STATES

# Where reports are looked for below a project's root, the first of a kind that is configured wins.
JUNIT = ("junit.xml", "test-results/junit.xml", "test-results.xml", "pytest-results.xml", ".pytest_cache/junit.xml", "reports/junit.xml", "build/test-results/junit.xml", "target/surefire-reports/*.xml")
COVERAGE = ("coverage.xml", "coverage/coverage.xml", "lcov.info", "coverage/lcov.info", ".coverage.xml")
CRASH = (".pytest_cache/crash.log",)
HINT_NODES = 20


def active_scopes(commands: DataFrame) -> DataFrame:
    """The scope of each project after set and clear commands (project_id, seq, action, allowed, forbidden); at most one
    is active, since each command ends the one before. A scope without allowed patterns is none."""
    last = commands.groupBy("project_id").agg(F.max_by(F.struct("action", "allowed", "forbidden"), "seq").alias("c"))
    return last.where("c.action = 'set' and size(c.allowed) > 0").select("project_id", "c.allowed", F.coalesce("c.forbidden", F.array().cast("array<string>")).alias("forbidden"))


def levels(projects: DataFrame, commands: DataFrame) -> DataFrame:
    """The notification level of each project, medium without a valid command."""
    valid = commands.where(F.col("level").isin("high", "medium", "low", "silent")).groupBy("project_id").agg(F.max_by("level", "seq").alias("level"))
    return projects.select("project_id").distinct().join(valid, "project_id", "left").fillna("medium", ["level"])


def net_states(commands: DataFrame) -> DataFrame:
    """Triggered or dismissed for each project and kind of warning; a dismissal holds whatever comes later."""
    return commands.groupBy("project_id", "net_type").agg(F.when(F.max((F.col("action") == "dismiss").cast("int")) == 1, "dismissed").otherwise("triggered").alias("state"))


def commit_points(commands: DataFrame, det: DataFrame) -> DataFrame:
    """For each project the place in the order at its last acknowledged commit: the last event not after the command
    (project_id, seq_at, action); a project without one has none."""
    acked = commands.where("action = 'acknowledge_commit'").groupBy("project_id").agg(F.max("seq_at").alias("at"))
    rows = det.join(acked, "project_id").where("seq <= at").groupBy("project_id").agg(F.max("seq").alias("last_commit_seq"))
    return acked.join(rows, "project_id", "left").select("project_id", F.coalesce("last_commit_seq", F.lit(0).cast("long")).alias("last_commit_seq"))


def sessions(events: DataFrame) -> DataFrame:
    """Sessions (project_id, session_id, start_seq, end_seq) of hook events (project_id, session_id, kind, seq): the first
    start counts, so a resumed session keeps its place; the last stop ends it."""
    start, stop = (F.col("kind") == k for k in ("session_start", "stop"))
    rows = events.where("session_id is not null").groupBy("project_id", "session_id").agg(F.min(F.when(start, F.col("seq"))).alias("start_seq"), F.max(F.when(stop, F.col("seq"))).alias("end_seq"))
    return rows.where("start_seq is not null")


def snapshots(commands: DataFrame, initial: DataFrame) -> DataFrame:
    """A marker for each git command that commits, rolls back or switches (project_id, seq, command, head), and for
    each session start (project_id, seq, head) whose commit has none: initial for a project's first, else session_start."""
    marks = commands.select("project_id", "seq", "head", git_kind(F.col("command")).alias("reason")).where("reason is not null")
    first = F.row_number().over(Window.partitionBy("project_id").orderBy("seq"))
    starts = initial.withColumn("reason", F.when(first == 1, "initial").otherwise("session_start")).select("project_id", "seq", "head", "reason")
    seen = marks.unionByName(starts.where("reason = 'initial'")).select("project_id", "head", F.col("seq").alias("at"))
    fresh = starts.where("reason = 'session_start'").join(seen.groupBy("project_id", "head").agg(F.min("at").alias("at")), ["project_id", "head"], "left").where("at is null or at > seq").drop("at")
    return marks.unionByName(starts.where("reason = 'initial'")).unionByName(fresh)


def reports_found(listing: DataFrame, configured: DataFrame, hints: tuple[str, ...] = JUNIT) -> DataFrame:
    """(project_id, rel_path, mtime) of the reports to read: the configured one if the listing has it, else all hints."""
    from chronoweave.functions.idents import matches_any

    mine = listing.join(configured.select("project_id", F.col("report").alias("rel_path")), ["project_id", "rel_path"], "left_semi")
    other = listing.where(matches_any(F.col("rel_path"), hints) & (F.size(F.split("rel_path", "/")) <= 3)).join(mine.select("project_id"), "project_id", "left_anti")
    return mine.select("project_id", "rel_path", "mtime").unionByName(other.select("project_id", "rel_path", "mtime"))


def not_ingested(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Reports whose (path, mtime) has no run yet."""
    return found.join(runs.select("project_id", F.col("source_path").alias("rel_path"), F.col("source_mtime").alias("mtime")), ["project_id", "rel_path", "mtime"], "left_anti")


def deliveries(before: DataFrame, after: DataFrame) -> DataFrame:
    """The messages that a round of the state machine sends: for each incident (incident, signal, target_node,
    agent, user) as many to a channel as its count rose."""
    key = ["incident", "signal", "target_node"]
    was = before.select(*key, F.col("agent").alias("a"), F.col("user").alias("u"))
    rows = after.join(was, key, "left").select(*key, (F.col("agent") - F.coalesce("a", F.lit(0))).alias("to_agent"), (F.col("user") - F.coalesce("u", F.lit(0))).alias("to_user"))
    each = rows.select(*key, F.explode(F.map_from_arrays(F.array(F.lit("agent"), F.lit("user")), F.array("to_agent", "to_user"))).alias("channel", "n")).where("n > 0")
    return each.select("incident", "channel", F.lit("alert").alias("kind"), message(F.col("signal"), F.col("target_node"), F.col("channel")).alias("message"))


def hook_response(event: Column, text: Column) -> Column:
    """{} without text, else the text as context for the event."""
    inner = F.struct(event.alias("hookEventName"), text.alias("additionalContext"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("{}")).otherwise(F.to_json(F.struct(inner.alias("hookSpecificOutput"))))


def stop_response(messages: DataFrame) -> DataFrame:
    """A30, 2.Q: for each project the decision at a stop: block with the untaken alerts to the user, in order of id.
    Suggestions never block."""
    mine = messages.where("channel = 'user' and kind = 'alert' and taken_at is null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "message"))), lambda x: x["message"]), "\n\n")
    return mine.groupBy("project_id").agg(F.to_json(F.struct(F.lit("block").alias("decision"), text.alias("reason"))).alias("response"))


def carried_over(messages: DataFrame, started: DataFrame) -> DataFrame:
    """2.Q: messages to the user that were not taken before a session began (project_id, started_us)."""
    rows = messages.where("channel = 'user' and taken_at is null").join(started, "project_id")
    return rows.where(F.col("created_us") < F.col("started_us")).drop("started_us")


def unresolved(incidents: DataFrame) -> DataFrame:
    """Incidents that are not resolved."""
    return incidents.where(F.col("state").isin(*OPENED_STATES))


def structure_hint(nodes: DataFrame, hinted: DataFrame) -> DataFrame:
    """Sessions (project_id, session_id) to hint at hubs: of projects with 20 graph nodes and more, each once.

    nodes: (project_id, session_id, graph_nodes); hinted: sessions that had the hint.
    """
    return nodes.where(F.col("graph_nodes") >= HINT_NODES).select("project_id", "session_id").distinct().join(hinted, ["project_id", "session_id"], "left_anti")


def new_members(now: DataFrame, told: DataFrame) -> DataFrame:
    """Suggestions (project_id, kind, defines) that name a define which the last one of the kind did not.

    told: (project_id, kind, csv), the defines told last, sorted and joined by commas; the result has the new csv.
    """
    rows = now.join(told, ["project_id", "kind"], "left")
    fresh = F.array_except("defines", F.split(F.coalesce("csv", F.lit("")), ","))
    return rows.where(F.size(fresh) > 0).select("project_id", "kind", F.array_join(F.array_sort("defines"), ",").alias("csv"))


def detail(details: Column, name: str) -> Column:
    """A field of an incident's JSON details as text; null where it is absent or the text is malformed."""
    return F.try_variant_get(F.try_parse_json(details), f"$.{name}", "string")
