"""Closures, distances and cones over directed edges; all tolerate cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.scratch import stored

from .components import components
from .ranks import top_rows

#: Rules: callers, callees, churn, fixed load, its percentile, defines needed for it, how many to report.
CALLERS, CALLEES, CHURN, LOAD, LOAD_SHARE, LOAD_DEFINES, TOP = 5, 6, 10, 20.0, 0.95, 50, 5
HIGH_IMPACT, REACH = 5, 4
#: Rows of the table of strides for each edge, at most, in closures from seeds.
STRIDES = 8


def closure(edges: DataFrame, node: str, up: str, seeds: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(node, ancestor, depth) of all pairs linked by a path of edges node -> up, with the least number of steps.

    H02, H11 to H14: from all nodes, or from the seeds (a column `node`), so the work follows the cones that are asked for.
    Pairs at the greatest depth so far go on by a table of strides: all pairs of up to s steps. Without seeds that table is
    what is known already, so depths double and the rounds grow with the logarithm of the longest path; with seeds it is
    doubled only as long as it stays within STRIDES times the edges, since it must hold all nodes. A pair at depth L + d
    has a node at depth L exactly on its shortest path, so a round makes no pair over all nodes between. Each round's new
    pairs are written; counts and the greatest depth reach the driver. A node on a cycle is its own ancestor. most:
    greatest depth.
    """
    hop = edges.select(F.col(node).alias("node"), F.col(up).alias("ancestor")).where("node is not null and ancestor is not null and node <> ancestor").distinct()
    hop = stored(hop.withColumn("depth", F.lit(1).cast("long")))
    level = hop if seeds is None else stored(hop.join(seeds.select("node").distinct(), "node", "left_semi"))
    known, strides = [level], [hop]
    deep, stride, room = 1, 1, 0 if seeds is None else STRIDES * hop.count()

    def further(front: DataFrame, table: list[DataFrame], done: list[DataFrame]) -> DataFrame:
        step = reduce(DataFrame.unionByName, table).select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        new = front.join(step, "ancestor").groupBy("node", F.col("further").alias("ancestor")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        return new.join(reduce(DataFrame.unionByName, done).select("node", "ancestor"), ["node", "ancestor"], "left_anti")

    while most is None or deep < most:
        if seeds is None:
            strides, stride = list(known), deep
        elif room and stride <= deep:  # strides of twice as many steps, if there are not too many
            wider = stored(further(strides[-1].where(F.col("depth") == stride), strides, strides))
            n = wider.count()
            room = max(0, room - n)
            if n and room:
                strides, stride = [*strides, wider], 2 * stride
            else:
                room = 0
        new = further(known[-1].where(F.col("depth") == deep), strides, known)
        new = stored(new if most is None else new.where(F.col("depth") <= most))
        reached = new.agg(F.max("depth")).first()[0]
        if reached is None:
            break
        known.append(new)
        if reached < deep + stride:
            break
        deep += stride
    return reduce(DataFrame.unionByName, known)


def cone_sizes(pairs: DataFrame) -> DataFrame:
    """How many strict ancestors each node has; a node on a cycle is not counted among its own."""
    return pairs.where("node <> ancestor").groupBy("node").agg(F.count(F.lit(1)).alias("cone"))


def common_ancestors(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(u, v, common) for asked pairs: strict ancestors of both. Pairs without any have none in the result."""
    a = asked.join(pairs.select(F.col("node").alias("u"), "ancestor"), "u")
    return a.join(pairs.select(F.col("node").alias("v"), "ancestor"), ["v", "ancestor"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("common"))


def jaccard(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """Distance of the ancestor sets, each with its node: |difference| / |union|, from sizes and common members."""
    own = asked.select(F.col("u").alias("node")).unionByName(asked.select(F.col("v").alias("node"))).distinct()
    full = pairs.select("node", "ancestor").join(own, "node", "left_semi").unionByName(own.select("node", F.col("node").alias("ancestor"))).distinct()
    sizes = full.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    common = common_ancestors(full, asked)
    out = asked.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").join(sizes.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v").join(common, ["u", "v"], "left")
    both = F.coalesce("common", F.lit(0))
    return out.select("u", "v", ((F.col("nu") + F.col("nv") - 2 * both) / (F.col("nu") + F.col("nv") - both)).alias("distance"))


def shared_successors(edges: DataFrame, frm: str, to: str, members: DataFrame | None = None) -> DataFrame:
    """(node, peer) of distinct nodes with a direct successor in common, for the members asked for.

    Asking bounds the result: all pairs of a popular successor's predecessors grow with their square.
    """
    e = edges.select(F.col(frm).alias("node"), F.col(to).alias("succ")).distinct()
    mine = e if members is None else e.join(members, "node", "left_semi")
    return mine.join(e.withColumnRenamed("node", "peer"), "succ").where("node <> peer").select("node", "peer").distinct()


def bounded_reach(edges: DataFrame, frm: str, to: str, members: DataFrame, most: int = REACH) -> DataFrame:
    """(node, peer, steps) over shared-successor links up to `most` steps from the members.

    Each step goes to the successors and back to their predecessors; pairs of predecessors are never made, so a popular
    successor costs its edges once for each member that reaches it.
    """
    e = stored(edges.select(F.col(frm).alias("at"), F.col(to).alias("succ")).distinct())
    known = stored(members.select("node", F.col("node").alias("peer")).distinct())
    level, found = known, []
    for step in range(1, most + 1):
        via = level.withColumnRenamed("peer", "at").join(e, "at").select("node", "succ").distinct()
        peers = via.join(e.withColumnRenamed("at", "peer"), "succ").select("node", "peer").distinct()
        level = stored(peers.join(known, ["node", "peer"], "left_anti"))
        found.append(level.withColumn("steps", F.lit(step).cast("long")))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return reduce(DataFrame.unionByName, found)


def cone_with_depth(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """Transitive callers of the seeds with their least distance from any; seeds are left out."""
    pairs = closure(calls, "callee", "caller", seeds)
    out = pairs.groupBy(F.col("ancestor").alias("node")).agg(F.min("depth").alias("depth"))
    return out.join(seeds.select("node").distinct(), "node", "left_anti")


def fan_in(calls: DataFrame) -> DataFrame:
    """Distinct callers of each callee."""
    return calls.select("caller", "callee").distinct().groupBy(F.col("callee").alias("node")).agg(F.count(F.lit(1)).alias("callers"))


def fan_out(calls: DataFrame) -> DataFrame:
    return calls.select("caller", "callee").distinct().groupBy(F.col("caller").alias("node")).agg(F.count(F.lit(1)).alias("callees"))


def hubs(calls: DataFrame, k: int = 5) -> DataFrame:
    """the k callees with most callers, ties by name."""
    return fan_in(calls).orderBy(F.desc("callers"), "node").limit(k)


def cone_ranks(cone: DataFrame, calls: DataFrame, k: int = 5) -> DataFrame:
    """The cone's first k by transitive callees, by direct callers, and by distance; ties by name."""
    deps = closure(calls, "caller", "callee", cone.select("node")).where("node <> ancestor").groupBy("node").agg(F.count(F.lit(1)).alias("value"))
    n = F.coalesce("value", F.lit(0).cast("long")).alias("value")
    by = [
        ("delta", cone.select("node").join(deps, "node", "left").select("node", n), False),
        ("indegree", cone.select("node").join(fan_in(calls).withColumnRenamed("callers", "value"), "node", "left").select("node", n), False),
        ("distance", cone.select("node", F.col("depth").alias("value")), True),
    ]
    parts = []
    for name, rows, up in by:
        first = rows.orderBy(F.col("value").asc() if up else F.col("value").desc(), "node").limit(k)
        parts.append(first.select(F.lit(name).alias("ranking"), "node", "value"))
    return reduce(DataFrame.unionByName, parts)


def load(pairs: DataFrame, callers: DataFrame) -> DataFrame:
    """The sum of callers over each node's ancestors."""
    return pairs.where("node <> ancestor").join(callers.select(F.col("node").alias("ancestor"), "callers"), "ancestor").groupBy("node").agg(F.sum("callers").alias("load"))


def structural_metrics(nodes: DataFrame, calls: DataFrame, pairs: DataFrame, churn: DataFrame) -> DataFrame:
    """Callers, callees, churn and load of every node."""
    callers = fan_in(calls)
    out = nodes.select("node").join(callers, "node", "left").join(fan_out(calls), "node", "left").join(churn, "node", "left").join(load(pairs, callers), "node", "left")
    return out.fillna(0, ["callers", "callees", "load"]).fillna(1, ["churn"])


def structural_concerns(metrics: DataFrame, k: int = TOP) -> DataFrame:
    """Nodes over one threshold at least, by the number of thresholds, then the sum, then name; k of them.

    The load's threshold is its 95th percentile (interpolated) from 50 nodes on, else fixed; a load of 0 is never over.
    """
    limit = metrics.agg(F.when(F.count(F.lit(1)) >= LOAD_DEFINES, F.percentile("load", LOAD_SHARE)).otherwise(LOAD).alias("limit"))
    rows = metrics.withColumn("limit", limit.scalar())
    over = F.filter(F.array(F.when(F.col("callers") >= CALLERS, "callers"), F.when(F.col("callees") >= CALLEES, "callees"), F.when(F.col("churn") >= CHURN, "churn"), F.when((F.col("load") >= F.col("limit")) & (F.col("load") > 0), "lambda")), lambda x: x.isNotNull())
    rows = rows.withColumn("dims", F.array_join(over, ",")).withColumn("hits", F.size(over).cast("long")).where("hits > 0")
    rows = rows.withColumn("total", F.col("callers") + F.col("callees") + F.col("churn") + F.col("load"))
    return rows.orderBy(F.desc("hits"), F.desc("total"), "node").limit(k).select("node", "callers", "callees", "churn", "load", "dims")


def high_impact(edges: DataFrame, names: DataFrame, least: int = HIGH_IMPACT, shown: int = 3) -> DataFrame:
    """Nodes with at least `least` direct successors and up to `shown` of their names, least first."""
    e = edges.select(F.col("from_det").alias("node"), "to_det").distinct()
    big = e.groupBy("node").agg(F.count(F.lit(1)).alias("callers")).where(F.col("callers") >= least)
    named = e.join(big, "node", "left_semi").join(names.select(F.col("node").alias("to_det"), "name"), "to_det")
    first = top_rows(named.select("node", "name").distinct(), ["node"], [F.col("name")], shown)
    return big.join(first.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("examples")), "node", "left")


def component_profile(nodes: DataFrame, edges: DataFrame, kind: str, k: int = 8, shown: int = 3) -> DataFrame:
    """The k largest components with their size and their most frequent values of `kind`."""
    of = components(edges, "from_det", "to_det", nodes)
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(k)
    often = of.join(F.broadcast(sizes.select("component")), "component").join(nodes, "node").groupBy("component", kind).agg(F.count(F.lit(1)).alias("n"))
    best = top_rows(often, ["component"], [F.desc("n"), F.col(kind)], shown)
    shown_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(kind).alias("v")))), lambda x: x["v"]), ",")
    return sizes.join(best.groupBy("component").agg(shown_text.alias("most")), "component")


def chase(redirects: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """Follows (module, name) through re-exports until a known symbol, the end of the chain or a cycle.

    redirects: (barrel_module, exported_name, target_module, target_name); an exact entry comes before a `*` one, whose
    name goes on unchanged; of several the least target counts. names: (module, name). known: (module, name) symbols.
    Result: names with resolved module and name, null if the chain ends at no symbol.

    First the places that names lead to are found, each once whatever leads there; then every place's target is replaced
    by its target's target until nothing moves, so rounds grow with the logarithm of the longest chain. Who has not
    arrived after as many steps as there are places goes round in a cycle.
    """
    least = lambda rows, *by: rows.groupBy(*by).agg(F.min(F.struct("to", "to_name")).alias("t")).select(*by, "t.to", "t.to_name")
    exact = redirects.where("exported_name <> '*'").select(F.col("barrel_module").alias("at"), F.col("exported_name").alias("as"), F.col("target_module").alias("to"), F.coalesce("target_name", "exported_name").alias("to_name"))
    star = redirects.where("exported_name = '*'").select(F.col("barrel_module").alias("at"), F.col("target_module").alias("to"), F.lit("*").alias("to_name"))
    exact, star = stored(least(exact, "at", "as")), stored(least(star, "at").select("at", F.col("to").alias("star_to")))
    symbols = stored(known.select(F.col("module").alias("at"), F.col("name").alias("as"), F.lit(True).alias("symbol")).distinct())
    if exact.isEmpty() and star.isEmpty():  # a name leads to itself or nowhere
        here = symbols.select(F.col("at").alias("module"), F.col("as").alias("name"), F.col("at").alias("to_module"), F.col("as").alias("to_name"))
        return names.select("module", "name").distinct().join(here, ["module", "name"], "left")
    front = stored(names.select(F.col("module").alias("at"), F.col("name").alias("as")).distinct())
    places, seen = [], [front]
    while True:
        rows = front.join(symbols, ["at", "as"], "left").join(exact, ["at", "as"], "left").join(star, "at", "left")
        moves = F.col("symbol").isNull() & (F.col("to").isNotNull() | F.col("star_to").isNotNull())
        to = F.when(moves, F.struct(F.coalesce("to", "star_to").alias("at"), F.when(F.col("to").isNotNull(), F.col("to_name")).otherwise(F.col("as")).alias("as")))
        rows = stored(rows.select("at", "as", F.coalesce("symbol", F.lit(False)).alias("symbol"), to.alias("to")))
        places.append(rows)
        front = rows.where("to is not null").select("to.at", "to.as").distinct().join(reduce(DataFrame.unionByName, seen), ["at", "as"], "left_anti")
        front = stored(front)
        if front.isEmpty():
            break
        seen.append(front)
    every = reduce(DataFrame.unionByName, places)
    ends = every.where("to is null").select(F.struct("at", "as").alias("end"), "symbol")
    jumps = stored(every.where("to is not null").select(F.struct("at", "as").alias("here"), "to"))
    steps, most = 1, jumps.count()
    while steps < most:
        after = jumps.select(F.col("here").alias("to"), F.col("to").alias("further"))
        step = stored(jumps.join(after, "to", "left").select("here", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            break
        jumps, steps = step.drop("moved"), 2 * steps
    arrived = jumps.withColumnRenamed("to", "end").join(ends.where("symbol"), "end").select("here", "end").unionByName(ends.where("symbol").select(F.col("end").alias("here"), "end"))
    out = names.select("module", "name").distinct().withColumn("here", F.struct(F.col("module").alias("at"), F.col("name").alias("as"))).join(arrived, "here", "left")
    return out.select("module", "name", F.col("end.at").alias("to_module"), F.col("end.as").alias("to_name"))


def propagate_labels(edges: DataFrame, labels: DataFrame, frm: str, to: str) -> DataFrame:
    """(node, lang) where each node gets the labels of all nodes it leads to over edges, its own included."""
    reach = closure(edges, frm, to)
    got = reach.join(labels.select(F.col("node").alias("ancestor"), "lang"), "ancestor").select("node", "lang")
    return got.unionByName(labels.select("node", "lang")).distinct()


def acyclic_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges without self-loops and cycles. Edges between strongly connected components stay; inside one only those
    that ascend in order (node, seq, id) do, so the result is acyclic whatever the order of arrival.

    Edges that ascend stay anyway, so only the others, which arrive out of order, are followed: one closes a cycle if its
    end leads back to its begin."""
    e = edges.select("from_det", "to_det").where("from_det <> to_det").distinct()
    o = order.select("node", F.struct("seq", "id").alias("o"))
    rows = e.join(o.select(F.col("node").alias("from_det"), F.col("o").alias("a")), "from_det").join(o.select(F.col("node").alias("to_det"), F.col("o").alias("b")), "to_det")
    rows = stored(rows.select("from_det", "to_det", (F.col("a") < F.col("b")).alias("up")))
    late = rows.where("not up").select("from_det", "to_det")
    if late.isEmpty():
        return rows.select("from_det", "to_det")
    reach = closure(e, "from_det", "to_det", late.select(F.col("to_det").alias("node")))
    back = reach.select(F.col("node").alias("to_det"), F.col("ancestor").alias("from_det"))
    return rows.where("up").select("from_det", "to_det").unionByName(late.join(back, ["from_det", "to_det"], "left_anti"))


def current_edges(calls: DataFrame, current: DataFrame) -> DataFrame:
    """Edges between the current versions of defines, from what is called to what calls it.

    calls: (caller, callee) names; current: (fqn, id) of live defines. Edges of replaced versions have no row, so nothing
    is deleted when a define changes.
    """
    a, b = current.select(F.col("fqn").alias("callee"), F.col("id").alias("from_det")), current.select(F.col("fqn").alias("caller"), F.col("id").alias("to_det"))
    return calls.select("caller", "callee").distinct().join(a, "callee").join(b, "caller").where("from_det <> to_det").select("from_det", "to_det").distinct()


def suspects(cone: DataFrame, stacks: DataFrame, last: int = 3) -> DataFrame:
    """Nodes of cones that the last crash stacks (id, stack_fqns) hold: those of each project, if both sides have a
    project_id."""
    by = [c for c in ("project_id",) if c in cone.columns and c in stacks.columns]
    newest = top_rows(stacks, by, [F.desc("id")], last) if by else stacks.orderBy(F.desc("id")).limit(last)
    recent = newest.select(*by, F.explode("stack_fqns").alias("node")).distinct()
    return cone.join(recent, [*by, "node"], "left_semi")


def loop_suspects(targets: DataFrame, calls: DataFrame, stacks: DataFrame, last: int = 5, k: int = 3) -> DataFrame:
    """(node, suspects) for each target: of its transitive callees those on the last crash stacks, the first k by name;
    without any the k with most transitive callees of their own."""
    pairs = closure(calls, "caller", "callee", targets).where("node <> ancestor").select(F.col("node").alias("target"), F.col("ancestor").alias("node"))
    crashed = suspects(pairs, stacks, last)
    deep = closure(calls, "caller", "callee", pairs.select("node")).where("node <> ancestor").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    deep = pairs.join(crashed.select("target").distinct(), "target", "left_anti").join(deep, "node", "left").fillna(0, ["n"])
    first = top_rows(crashed, ["target"], [F.col("node")], k).select("target", F.lit(0).cast("long").alias("n"), "node")
    rows = first.unionByName(top_rows(deep, ["target"], [F.desc("n"), F.col("node")], k).select("target", "n", "node"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "node")))
    found = rows.groupBy(F.col("target").alias("node")).agg(F.transform(listed, lambda x: x["node"]).alias("suspects"))
    return targets.select("node").distinct().join(found, "node", "left")


def not_warned(found: DataFrame, warned: DataFrame, by: list[str]) -> DataFrame:
    """Findings that were not told yet with these keys (project, session, define), each once."""
    return found.join(warned.select(*by).distinct(), by, "left_anti").dropDuplicates(by)


def alive(nodes: DataFrame, members: DataFrame, node: str = "node") -> DataFrame:
    """Nodes (lang::module.define, or without the language) that are members of an equivalence class, that is, live."""
    bare = F.regexp_replace(node, "^[a-z_]+::", "")
    return nodes.withColumn("_bare", bare).join(members.select(F.regexp_replace("member", "^[a-z_]+::", "").alias("_bare")).distinct(), "_bare", "left_semi").drop("_bare")
