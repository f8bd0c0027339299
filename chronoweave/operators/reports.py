"""Reports over changes, outcomes, graphs and costs. Each is a small DataFrame; texts are rendered by functions.messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.idents import is_test_file

from .chains import CHAIN, changed_since, define_summary
from .intervals import within
from .ranks import top_rows

# Tokens of a round, list prices per million tokens (input, cache read, output), rounds saved by a stop.
ROUND_TOKENS = (5000, 1000, 2000)
ROUNDS_SAVED = 15 // 3
#: Safety net: edits and defines from which tests are missed, edits since a commit, how often it is looked at.
NET_DEFINES, NET_EDITS, NET_UNCOMMITTED, NET_EVERY = 10, 5, 15, 20
HUB, CHANGE, BLAST, REST = 3, 3, 3, 5


def cost_by_model(samples: DataFrame) -> DataFrame:
    """Samples, cost and tokens of each model, the dearest first."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("cost_usd", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens") if c in samples.columns]
    return samples.groupBy("model").agg(F.count(F.lit(1)).alias("samples"), *sums).orderBy(F.desc("total_cost_usd"), "model")


def bridged(samples: DataFrame, sessions: DataFrame) -> DataFrame:
    """Samples with the project of their session, null for unknown sessions; a session counts once."""
    one = sessions.groupBy("session_id").agg(F.min("project_id").alias("project_id"))
    return samples.join(one, "session_id", "left")


def round_cost(price: DataFrame, model: Column | str = "model") -> DataFrame:
    """2.L: dollars of a typical round for each priced model (input, cache, output per million tokens)."""
    i, c, o = ROUND_TOKENS
    return price.select(model, ((F.col("input") * i + F.col("cache") * c + F.col("output") * o) / 1e6).alias("round_cost"))


def priced(models: DataFrame, price: DataFrame) -> DataFrame:
    """2.L: the price of each model: of that name, or of the longest priced name that it begins with.

    Prefixes are exploded, so it is an equi join.
    """
    ups = F.transform(F.sequence(F.lit(1), F.length("model")), lambda n: F.substring("model", F.lit(1), n))
    rows = models.where("length(model) > 0").withColumn("_p", F.explode(ups)).join(price.withColumnRenamed("model", "_p"), "_p")
    return rows.groupBy("model").agg(F.max_by(F.struct(F.col("_p").alias("priced_as"), "input", "cache", "output"), F.length("_p")).alias("r")).select("model", "r.*")


def savings(incidents: DataFrame, total_cost: DataFrame, rounds: DataFrame) -> DataFrame:
    """For each project the stopped loops, and what five rounds saved by each are worth at its mean cost of a round.

    total_cost: (project_id, total_cost); rounds: (project_id, max_seq).
    """
    stopped = incidents.where(F.col("signal").isin("token_waste", "define_loop") & F.col("state").isin("resolved", "escalated_user")).groupBy("project_id").agg(F.count(F.lit(1)).alias("stopped"))
    rows = rounds.join(total_cost, "project_id", "left").join(stopped, "project_id", "left").fillna(0, ["stopped"]).fillna(0.0, ["total_cost"])
    worth = F.when((F.col("max_seq") > 0) & (F.col("total_cost") > 0), F.col("stopped") * ROUNDS_SAVED * F.col("total_cost") / F.col("max_seq")).otherwise(0.0)
    return rows.withColumn("saved", worth)


def busiest(det: DataFrame, k: int = 5) -> DataFrame:
    """The k defines with most events, ties by key."""
    rows = det.where("define_name is not null").groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("edits"))
    return rows.orderBy(F.desc("edits"), *CHAIN).limit(k)


def overview(det: DataFrame, incidents: DataFrame) -> DataFrame:
    """For each project files, defines, events, and signals that are not resolved."""
    base = det.groupBy("project_id").agg(F.count_distinct("file_path").alias("files"), F.count_distinct("file_path", "define_name").alias("defines"), F.count(F.lit(1)).alias("events"), F.max("seq").alias("max_seq"))
    open_ = incidents.where("state <> 'resolved'").groupBy("project_id").agg(F.count(F.lit(1)).alias("open_incidents"), F.array_join(F.sort_array(F.collect_set("signal")), ",").alias("signals"))
    return base.join(open_, "project_id", "left").fillna(0, ["open_incidents"]).fillna("", ["signals"])


def coverage_share(det: DataFrame, covered_files: DataFrame, empty_files: DataFrame) -> DataFrame:
    """Covered files over files with defines; 1 where there are none."""
    files = det.groupBy("project_id").agg(F.count_distinct("file_path").alias("files"))
    some = covered_files.groupBy("project_id").agg(F.count_distinct("file_path").alias("covered"))
    none = empty_files.groupBy("project_id").agg(F.count_distinct("file_path").alias("empty"))
    rows = files.join(some, "project_id", "left").join(none, "project_id", "left").fillna(0, ["covered", "empty"])
    base = F.col("files") - F.col("empty")
    return rows.select("project_id", "files", "covered", F.when(base <= 0, 1.0).otherwise(F.col("covered") / base).alias("share"))


def recap(sessions: DataFrame, det: DataFrame, incidents: DataFrame) -> DataFrame:
    """For each project its last ended session: events, files, and incidents created between its first and last event."""
    last = sessions.where("end_seq is not null").groupBy("project_id").agg(F.max_by(F.struct("session_id", "start_seq", "end_seq"), "start_seq").alias("s")).select("project_id", "s.*")
    rows = within(det, last, ["project_id"], "seq", "start_seq", "end_seq")
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    out = rows.groupBy("project_id", "session_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("file_path").alias("files"), F.min(at).alias("a"), F.max(at).alias("b"))
    hits = within(incidents.select("project_id", F.col("created_us").alias("at")), out.select("project_id", "a", "b"), ["project_id"], "at", "a", "b", width=3_600_000_000, open_low=False).groupBy("project_id").agg(F.count(F.lit(1)).alias("incidents"))
    return out.drop("a", "b").join(hits, "project_id", "left").fillna(0, ["incidents"])


def debug_range(sessions: DataFrame, det: DataFrame, last: int = 3) -> DataFrame:
    """For each project the range of its last sessions, and the defines changed in it."""
    order = Window.partitionBy("project_id").orderBy(F.desc("start_seq"))
    recent = sessions.withColumn("n", F.row_number().over(order)).where(F.col("n") <= last)
    top = det.groupBy("project_id").agg(F.max("seq").alias("top"))
    span = recent.join(top, "project_id").groupBy("project_id").agg(F.min("start_seq").alias("low"), F.max(F.coalesce("end_seq", "top")).alias("high"))
    rows = within(det, span, ["project_id"], "seq", "low", "high")
    return rows.groupBy("project_id", "low", "high").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("file_path", "define_name").alias("defines"))


def calibration(incidents: DataFrame) -> DataFrame:
    """For each signal incidents, share told to the user, and percentiles of the seconds to resolve, one
    decimal, halves to even."""
    seconds = F.when(F.col("state") == "resolved", (F.col("updated_us") - F.col("created_us")) / 1e6)
    p = F.percentile(seconds, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    rows = incidents.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("state") == "escalated_user").cast("double")).alias("told"), F.min(seconds).alias("least"), p.alias("p"), F.max(seconds).alias("most"))
    return rows.select("signal", "n", F.bround("told", 4).alias("told"), F.bround("least", 1).alias("least"), *[F.bround(F.col("p")[i], 1).alias(x) for i, x in enumerate(("p25", "median", "p75"))], F.bround("most", 1).alias("most"))


def safety_net(det: DataFrame, runs: DataFrame, commits: DataFrame) -> DataFrame:
    """For each project the warnings: no tests (from 5 edits and 10 defines on), or 15 edits and more since the last
    commit. runs: (project_id); commits: (project_id, seq)."""
    rows = det.groupBy("project_id").agg(F.count(F.lit(1)).alias("edits"), F.count_distinct("file_path", "define_name").alias("defines"), F.max("seq").alias("max_seq"), F.max(is_test_file(F.col("file_path"))).alias("has_tests"))
    ran = runs.select("project_id", F.lit(True).alias("ran")).distinct()
    last = commits.groupBy("project_id").agg(F.max("seq").alias("commit_seq"))
    rows = rows.join(ran, "project_id", "left").join(last, "project_id", "left")
    large = (F.col("edits") >= NET_EDITS) & (F.col("defines") >= NET_DEFINES)
    no_tests = large & F.col("ran").isNull() & ~F.col("has_tests")
    behind = large & (F.col("commit_seq").isNull() | (F.col("max_seq") - F.col("commit_seq") >= NET_UNCOMMITTED))
    return rows.select("project_id", "edits", "defines", no_tests.alias("no_tests"), behind.alias("uncommitted"))


def inline_assist(det: DataFrame, callers: DataFrame, coverage: DataFrame, ran: DataFrame, since: int) -> DataFrame:
    """At most one suggestion for each project, the first that holds: commit (a stable cluster of three defines or more
    since the commit), run_tests (a changed covered define whose cases did not run since), blast_radius (the changed define
    with most callers, three at least). callers: (define key, callers); ran: (project_id, test_case, seq)."""
    changed = changed_since(det, since)
    top = det.groupBy("project_id").agg(F.max("seq").alias("max_seq"))
    cluster = changed.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.max("last_seq").alias("s")).join(top, "project_id")
    commit = cluster.where((F.col("n") >= CHANGE) & (F.col("max_seq") - F.col("s") >= REST)).select("project_id", F.lit(1).alias("rank"), F.lit("commit").alias("kind"), F.lit("").alias("target"))
    late = changed.join(coverage, ["project_id", "file_path", "define_name"]).join(ran.groupBy("project_id", "test_case").agg(F.max("seq").alias("ran")), ["project_id", "test_case"], "left")
    late = late.groupBy("project_id", "file_path", "define_name").agg(F.every(F.coalesce(F.col("ran") < F.col("last_seq"), F.lit(True))).alias("late")).where("late")
    key = F.concat_ws("::", "file_path", "define_name")
    tests = late.groupBy("project_id").agg(F.min(key).alias("target")).select("project_id", F.lit(2).alias("rank"), F.lit("run_tests").alias("kind"), "target")
    wide = changed.join(callers, ["project_id", "file_path", "define_name"]).where(F.col("callers") >= BLAST)
    blast = wide.groupBy("project_id").agg(F.min(F.struct((-F.col("callers")).alias("c"), key.alias("target"))).alias("m")).select("project_id", F.lit(3).alias("rank"), F.lit("blast_radius").alias("kind"), "m.target")
    every = commit.unionByName(tests).unionByName(blast)
    return every.groupBy("project_id").agg(F.min(F.struct("rank", "kind", "target")).alias("m")).select("project_id", "m.kind", "m.target")


def briefing(nodes: DataFrame, calls: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """For each asked node (node) its callers, callees, peers with a common successor, and its component's size."""
    from .graph import fan_in, fan_out, shared_successors

    peers = shared_successors(edges, "from_det", "to_det", nodes).groupBy("node").agg(F.count(F.lit(1)).alias("peers"))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    out = nodes.join(fan_in(calls), "node", "left").join(fan_out(calls), "node", "left").join(peers, "node", "left").join(parts, "node", "left").join(sizes, "component", "left")
    return out.select("node", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("callers", "callees", "peers")], F.coalesce("size", F.lit(1)).cast("long").alias("component_size"))


def resolve_histogram(incidents: DataFrame, reasons: Column) -> DataFrame:
    """Resolved incidents by signal and how they ended."""
    return incidents.where("state = 'resolved'").groupBy("signal", reasons.alias("resolved_by")).agg(F.count(F.lit(1)).alias("n"))


def modules(det: DataFrame, k: int = 5) -> DataFrame:
    """The k files of each project with most events, ties by path: (project_id, modules), each as path:events."""
    edits = det.groupBy("project_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    best = top_rows(edits, ["project_id"], [F.desc("n"), F.col("file_path")], k)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "file_path", "n")))
    return best.groupBy("project_id").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["file_path"], x["n"])), ",").alias("modules"))


def project_overview(det: DataFrame, incidents: DataFrame, calls: DataFrame, net: DataFrame, concerns: DataFrame, k: int = 3) -> DataFrame:
    """Overview, the busiest files, the hubs of each project's calls (project_id, caller, callee), warnings of the safety
    net, and the nodes of structural concern (project_id, node)."""
    fan = calls.groupBy("project_id", "callee").agg(F.count_distinct("caller").alias("n"))
    best = top_rows(fan, ["project_id"], [F.desc("n"), F.col("callee")], k)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "callee", "n")))
    hubs = best.groupBy("project_id").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["callee"], x["n"])), ",").alias("hubs"))
    odd = concerns.groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("node").cast("string"))), ",").alias("concerns"))
    rows = overview(det, incidents).join(modules(det), "project_id", "left").join(hubs, "project_id", "left").join(odd, "project_id", "left")
    return rows.join(net.select("project_id", "no_tests", "uncommitted"), "project_id", "left").fillna("", ["hubs", "concerns"])


def range_report(sessions: DataFrame, det: DataFrame, calls: DataFrame, stacks: DataFrame, last: int = 3, k: int = 5) -> DataFrame:
    """For each project the range of its last sessions with its changes, the cone of callers (calls: project_id, caller,
    callee, of names file::define) around the changed defines, the suspects on the last crash stacks, and the first nodes of
    the cone by callers and by distance."""
    from .graph import closure, suspects

    span = debug_range(sessions, det, last)
    rows = within(det, span.select("project_id", "low", "high"), ["project_id"], "seq", "low", "high")
    tag = lambda name: F.concat_ws("|", F.col("project_id").cast("string"), name)  # noqa: E731  # one graph of all projects
    changed = rows.select(tag(F.concat_ws("::", "file_path", "define_name")).alias("node")).distinct()
    graph = calls.select(tag(F.col("caller")).alias("caller"), tag(F.col("callee")).alias("callee"))
    cone = closure(graph, "callee", "caller", changed).groupBy(F.col("ancestor").alias("node")).agg(F.min("depth").alias("depth"))
    cone = cone.unionByName(changed.withColumn("depth", F.lit(0).cast("long"))).groupBy("node").agg(F.min("depth").alias("depth"))
    cone = cone.select(F.substring_index("node", "|", 1).cast("long").alias("project_id"), F.expr("substring(node, instr(node, '|') + 1)").alias("node"), "depth")
    fan = calls.groupBy("project_id", F.col("callee").alias("node")).agg(F.count_distinct("caller").alias("callers"))
    ranked = cone.join(fan, ["project_id", "node"], "left").fillna(0, ["callers"])

    def first(order: Column, name: str) -> DataFrame:
        best = top_rows(ranked.withColumn("_o", order), ["project_id"], [F.col("_o"), F.col("node")], k)
        return best.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "node"))), lambda x: x["node"]), ",").alias(name))

    odd = suspects(cone, stacks).groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_set("node")), ",").alias("suspects"))
    out = span.join(cone.groupBy("project_id").agg(F.count(F.lit(1)).alias("cone")), "project_id", "left").join(odd, "project_id", "left")
    return out.join(first(-F.col("callers"), "by_callers"), "project_id", "left").join(first(F.col("depth"), "by_distance"), "project_id", "left").fillna("", ["suspects", "by_callers", "by_distance"])


def savings_report(rounds: DataFrame, measured: DataFrame, models: DataFrame, prices: DataFrame, incidents: DataFrame) -> DataFrame:
    """For each project the best tier that its data allow: measured cost (project_id, total_cost); else its model's
    (project_id, model) list price for its rounds; else counts alone. Saved is what five rounds of each stopped loop cost."""
    price = round_cost(priced(models.select("model").distinct(), prices))
    rows = savings(incidents, measured, rounds).drop("saved").join(models, "project_id", "left").join(price, "model", "left")
    tier = F.when(F.col("total_cost") > 0, 1).when(F.col("round_cost").isNotNull(), 2).otherwise(3)
    cost = F.when(tier == 1, F.col("total_cost")).when(tier == 2, F.col("max_seq") * F.col("round_cost"))
    each = F.when(tier == 1, F.col("total_cost") / F.col("max_seq")).when(tier == 2, F.col("round_cost"))
    return rows.select("project_id", tier.alias("tier"), "max_seq", "stopped", cost.alias("cost"), (F.col("stopped") * ROUNDS_SAVED * each).alias("saved"))
