"""Graphs: closures, distances, cones, hubs and concerns."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave import adapters as A
from chronoweave.operators import chains as C
from chronoweave.operators import graph as G
from chronoweave.operators.components import components

from .registry import query

SEEDS = (1, 2, 3)


def _pairs(spark, sf_dir, seeds=None):
    return G.closure(A.gd_edges(spark, sf_dir), "to_det", "from_det", seeds)


def _seeds(spark, sf_dir):
    return A.raw(spark, sf_dir, "part").where(F.col("p_partkey").isin(*SEEDS)).select(F.col("p_partkey").alias("node"))


def _asked(spark, sf_dir):
    """Neighbouring parts, as pairs whose distance is asked for."""
    p = A.raw(spark, sf_dir, "part").where("p_partkey > 0")
    return p.select(F.col("p_partkey").alias("u"), (F.col("p_partkey") - 1).alias("v"))


@query("SELECT t AS node, count(*) AS predecessors, CAST(sum(f) AS BIGINT) AS total FROM gd GROUP BY 1")
def direct_neighbors(spark, sf_dir):
    return A.gd_edges(spark, sf_dir).groupBy(F.col("to_det").alias("node")).agg(F.count(F.lit(1)).alias("predecessors"), F.sum("from_det").alias("total"))


@query("SELECT node, a AS ancestor FROM anc")
def strict_ancestors(spark, sf_dir):
    return _pairs(spark, sf_dir).select("node", "ancestor")


@query("SELECT p_partkey AS node, count(a) + 1 AS members FROM part LEFT JOIN anc ON node = p_partkey GROUP BY 1")
def ancestor_set(spark, sf_dir):
    nodes = A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return nodes.join(G.cone_sizes(_pairs(spark, sf_dir)), "node", "left").select("node", (F.coalesce("cone", F.lit(0)) + 1).alias("members"))


@query("SELECT p_partkey AS node, EXISTS (SELECT 1 FROM anc WHERE node = p_partkey AND a = 5) AS below FROM part")
def is_ancestor(spark, sf_dir):
    """By closure of the asked ancestor's successors only."""
    edges, asked = A.gd_edges(spark, sf_dir), A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    start = A.raw(spark, sf_dir, "part").where("p_partkey = 5").select(F.col("p_partkey").alias("node"))
    under = G.closure(edges, "from_det", "to_det", start).select(F.col("ancestor").alias("node"), F.lit(True).alias("below"))
    return asked.join(under, "node", "left").select("node", F.coalesce("below", F.lit(False)).alias("below"))


_ASKED = "q AS (SELECT p_partkey AS u, p_partkey - 1 AS v FROM part WHERE p_partkey > 0)"


@query(f"WITH {_ASKED} SELECT u, v, count(*) AS common FROM q JOIN anc x ON x.node = u JOIN anc y ON y.node = v AND y.a = x.a GROUP BY 1, 2")
def omega(spark, sf_dir):
    return G.common_ancestors(_pairs(spark, sf_dir), _asked(spark, sf_dir))


@query(f"""WITH {_ASKED}, f AS (SELECT node, a FROM anc UNION SELECT p_partkey, p_partkey FROM part), n AS (SELECT node, count(*) AS n FROM f GROUP BY 1),
c AS (SELECT u, v, count(*) AS c FROM q JOIN f x ON x.node = u JOIN f y ON y.node = v AND y.a = x.a GROUP BY 1, 2)
SELECT u, v, round((nu.n + nv.n - 2 * coalesce(c, 0)) / (nu.n + nv.n - coalesce(c, 0)), 9) AS distance FROM q JOIN n nu ON nu.node = u JOIN n nv ON nv.node = v LEFT JOIN c USING (u, v)""")
def jaccard_distance(spark, sf_dir):
    return G.jaccard(_pairs(spark, sf_dir), _asked(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query("SELECT DISTINCT x.f AS node, y.f AS peer FROM gd x JOIN gd y ON x.t = y.t AND x.f <> y.f")
def shared_successor(spark, sf_dir):
    return G.shared_successors(A.gd_edges(spark, sf_dir), "from_det", "to_det")


@query("""WITH l AS (SELECT DISTINCT x.f AS a, y.f AS b FROM gd x JOIN gd y ON x.t = y.t AND x.f <> y.f),
r AS (SELECT a AS node, b AS peer, 1 AS steps FROM l WHERE a IN (1, 2, 3) UNION SELECT r.node, l.b, r.steps + 1 FROM r JOIN l ON l.a = r.peer WHERE r.steps < 4)
SELECT node, peer, CAST(min(steps) AS BIGINT) AS steps FROM r WHERE node <> peer GROUP BY 1, 2""")
def bounded_reach(spark, sf_dir):
    return G.bounded_reach(A.gd_edges(spark, sf_dir), "from_det", "to_det", _seeds(spark, sf_dir))


_COMPONENTS = "u AS (SELECT f AS x, t AS y FROM forest UNION ALL SELECT t, f FROM forest), r AS (SELECT p_partkey AS node, p_partkey AS o FROM part UNION SELECT u.y, r.o FROM r JOIN u ON u.x = r.node), comp AS (SELECT node, min(o) AS component FROM r GROUP BY 1)"


@query(f"WITH {_COMPONENTS} SELECT node, component FROM comp")
def components_all(spark, sf_dir):
    """Every part is a node; those without edges are components of their own."""
    return components(A.gd_forest(spark, sf_dir), "from_det", "to_det", A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@query(f"""WITH {_COMPONENTS}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 ORDER BY size DESC, component LIMIT 8),
k AS (SELECT component, p_type, count(*) AS n FROM comp JOIN part ON node = p_partkey WHERE component IN (SELECT component FROM s) GROUP BY 1, 2),
m AS (SELECT component, p_type, n FROM k QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, p_type) <= 3)
SELECT component, size, string_agg(p_type, ',' ORDER BY n DESC, p_type) AS most FROM s JOIN m USING (component) GROUP BY 1, 2""")
def component_profile(spark, sf_dir):
    nodes = A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_type")
    return G.component_profile(nodes, A.gd_forest(spark, sf_dir), "p_type")


@query("WITH s AS (SELECT f AS seed, t AS n FROM gd WHERE f IN (1, 2, 3) UNION SELECT seed, t FROM s JOIN gd ON f = n) SELECT DISTINCT n AS node FROM s WHERE n NOT IN (1, 2, 3)")
def successor_cone(spark, sf_dir):
    """What follows from the seeds, without them."""
    found = G.closure(A.gd_edges(spark, sf_dir), "from_det", "to_det", _seeds(spark, sf_dir))
    return found.select(F.col("ancestor").alias("node")).distinct().join(_seeds(spark, sf_dir), "node", "left_anti")


_CONE = "s AS (SELECT caller AS node, 1 AS depth FROM calls WHERE callee IN (1, 2, 3) UNION SELECT caller, depth + 1 FROM s JOIN calls ON callee = node), cone AS (SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM s WHERE node NOT IN (1, 2, 3) GROUP BY 1)"


@query(f"WITH {_CONE} SELECT node FROM cone")
def caller_cone(spark, sf_dir):
    return G.cone_with_depth(A.calls(spark, sf_dir), _seeds(spark, sf_dir)).select("node")


@query(f"WITH {_CONE} SELECT node, depth FROM cone")
def caller_depth(spark, sf_dir):
    return G.cone_with_depth(A.calls(spark, sf_dir), _seeds(spark, sf_dir))


@query("SELECT node, count(*) AS cone FROM anc GROUP BY 1")
def dependency_size(spark, sf_dir):
    return G.cone_sizes(G.closure(A.calls(spark, sf_dir), "caller", "callee"))


@query(f"""WITH {_CONE}, d AS (SELECT node, count(a) AS v FROM cone LEFT JOIN anc USING (node) GROUP BY 1), i AS (SELECT node, count(DISTINCT caller) AS v FROM cone LEFT JOIN calls ON callee = node GROUP BY 1)
(SELECT 'delta' AS ranking, node, v AS value FROM d ORDER BY v DESC, node LIMIT 5) UNION ALL (SELECT 'indegree', node, v FROM i ORDER BY v DESC, node LIMIT 5) UNION ALL (SELECT 'distance', node, depth FROM cone ORDER BY depth, node LIMIT 5)""")
def cone_ranks(spark, sf_dir):
    calls = A.calls(spark, sf_dir)
    return G.cone_ranks(G.cone_with_depth(calls, _seeds(spark, sf_dir)), calls)


@query("SELECT callee AS node, count(*) AS callers FROM hub GROUP BY 1 ORDER BY callers DESC, node LIMIT 5")
def hubs(spark, sf_dir):
    return G.hubs(A.hub_calls(spark, sf_dir))


@query("""WITH big AS (SELECT f AS node, count(*) AS callers FROM gd GROUP BY 1 HAVING count(*) >= 5),
n AS (SELECT DISTINCT node, p_name AS name FROM big JOIN gd ON f = node JOIN part ON p_partkey = t QUALIFY dense_rank() OVER (PARTITION BY node ORDER BY p_name) <= 3)
SELECT node, callers, string_agg(name, ',' ORDER BY name) AS examples FROM big JOIN n USING (node) GROUP BY 1, 2""")
def high_impact(spark, sf_dir):
    return G.high_impact(A.gd_edges(spark, sf_dir), A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")))


_CALLERS = "c AS (SELECT callee AS node, count(DISTINCT caller) AS callers FROM calls GROUP BY 1)"


@query(f"WITH {_CALLERS} SELECT anc.node, CAST(sum(callers) AS BIGINT) AS load FROM anc JOIN c ON c.node = anc.a GROUP BY 1")
def lambda_load(spark, sf_dir):
    return G.load(_pairs(spark, sf_dir), G.fan_in(A.calls(spark, sf_dir)))


_METRICS = f"""{_CALLERS}, o AS (SELECT caller AS node, count(DISTINCT callee) AS callees FROM calls GROUP BY 1), h AS (SELECT l_partkey AS node, count(*) AS churn FROM lineitem WHERE l_quantity < 10 GROUP BY 1),
l AS (SELECT anc.node, sum(callers) AS load FROM anc JOIN c ON c.node = anc.a GROUP BY 1),
m AS (SELECT p_partkey AS node, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(churn, 1) AS churn, CAST(coalesce(load, 0) AS BIGINT) AS load
FROM part LEFT JOIN c ON c.node = p_partkey LEFT JOIN o ON o.node = p_partkey LEFT JOIN h ON h.node = p_partkey LEFT JOIN l ON l.node = p_partkey),
q AS (SELECT CASE WHEN count(*) >= 50 THEN quantile_cont(load, 0.95) ELSE 20 END AS lim FROM m)"""


def _metrics(spark, sf_dir):
    nodes = A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    churn = A.raw(spark, sf_dir, "lineitem").where("l_quantity < 10").groupBy(F.col("l_partkey").alias("node")).agg(F.count(F.lit(1)).alias("churn"))
    return G.structural_metrics(nodes, A.calls(spark, sf_dir), _pairs(spark, sf_dir), churn)


@query(f"""WITH {_METRICS}, d AS (SELECT m.*, list_filter([CASE WHEN callers >= 5 THEN 'callers' END, CASE WHEN callees >= 6 THEN 'callees' END, CASE WHEN churn >= 10 THEN 'churn' END, CASE WHEN load >= lim AND load > 0 THEN 'lambda' END], lambda x: x IS NOT NULL) AS hit FROM m, q)
SELECT node, callers, callees, churn, load, array_to_string(hit, ',') AS dims FROM d WHERE len(hit) > 0 ORDER BY len(hit) DESC, callers + callees + churn + load DESC, node LIMIT 5""")
def structural_concerns(spark, sf_dir):
    return G.structural_concerns(_metrics(spark, sf_dir))


@query(f"WITH {_METRICS} SELECT min(load) AS least, round(quantile_cont(load, 0.25), 6) AS p25, round(quantile_cont(load, 0.5), 6) AS median, round(quantile_cont(load, 0.75), 6) AS p75, round(quantile_cont(load, 0.95), 6) AS p95, max(load) AS most FROM m")
def metric_percentiles(spark, sf_dir):
    """Interpolated percentiles, exact; one pass over counts of equal values."""
    p = F.percentile("load", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)])).alias("p")
    rows = _metrics(spark, sf_dir).agg(F.min("load").alias("least"), p, F.max("load").alias("most"))
    return rows.select("least", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p25", "median", "p75", "p95"))], "most")


def _redirects(spark, sf_dir):
    """Barrels of nine parts each: module m re-exports names of module m + 1, those of every fourth by a star, in cycles of 40."""
    p = A.raw(spark, sf_dir, "part").where("p_partkey % 3 > 0")
    m = F.floor(F.col("p_partkey") / 9).cast("long")
    to = F.when(m % 40 == 39, m - 39).otherwise(m + 1)
    named = p.where("floor(p_partkey / 9) % 4 > 0").select(m.alias("barrel_module"), F.concat(F.lit("n"), F.col("p_partkey") % 9).alias("exported_name"), to.alias("target_module"), F.concat(F.lit("n"), F.col("p_partkey") % 9).alias("target_name"))
    star = p.where("floor(p_partkey / 9) % 4 = 0").select(m.alias("barrel_module"), F.lit("*").alias("exported_name"), to.alias("target_module"), F.lit("*").alias("target_name")).distinct()
    return named.unionByName(star)


@query("""WITH p AS (SELECT p_partkey // 9 AS m, 'n' || p_partkey % 9 AS n, p_partkey % 3 AS z, p_partkey FROM part),
r AS (SELECT m AS bm, n AS en, CASE WHEN m % 40 = 39 THEN m - 39 ELSE m + 1 END AS tm FROM p WHERE z > 0 AND m % 4 > 0),
s AS (SELECT DISTINCT m AS bm, CASE WHEN m % 40 = 39 THEN m - 39 ELSE m + 1 END AS tm FROM p WHERE z > 0 AND m % 4 = 0),
k AS (SELECT m, n FROM p WHERE p_partkey % 11 = 0),
w(module, name, here, done) AS (SELECT m, n, m, EXISTS (SELECT 1 FROM k WHERE k.m = p.m AND k.n = p.n) FROM p
 UNION SELECT w.module, w.name, coalesce(r.tm, s.tm), EXISTS (SELECT 1 FROM k WHERE k.m = coalesce(r.tm, s.tm) AND k.n = w.name) FROM w LEFT JOIN r ON r.bm = w.here AND r.en = w.name LEFT JOIN s ON s.bm = w.here WHERE NOT done AND coalesce(r.tm, s.tm) IS NOT NULL)
SELECT module, name, max(CASE WHEN done THEN here END) AS to_module, max(CASE WHEN done THEN name END) AS to_name FROM w GROUP BY 1, 2""")
def reexport_chase(spark, sf_dir):
    p = A.raw(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 9).cast("long").alias("module"), F.concat(F.lit("n"), F.col("p_partkey") % 9).alias("name"))
    return G.chase(_redirects(spark, sf_dir), p, p.where("p_partkey % 11 = 0"))


@query("""WITH l AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 3 = 0 THEN 'py' ELSE 'js_ts' END AS lang FROM part WHERE p_partkey < 20)
SELECT DISTINCT anc.node, lang FROM anc JOIN l ON l.node = anc.a UNION SELECT node, lang FROM l""")
def lang_propagation(spark, sf_dir):
    lang = F.when(F.col("p_partkey") % 3 == 0, "py").otherwise("js_ts")
    labels = A.raw(spark, sf_dir, "part").where("p_partkey < 20").select(F.col("p_partkey").alias("node"), lang.alias("lang"))
    return G.propagate_labels(A.gd_edges(spark, sf_dir), labels, "to_det", "from_det")


@query("SELECT f AS from_det, t AS to_det FROM gd UNION SELECT p_partkey + 1, p_partkey FROM part WHERE p_partkey % 100 = 7 AND NOT EXISTS (SELECT 1 FROM anc WHERE node = p_partkey + 1 AND a = p_partkey)")
def acyclic_edges(spark, sf_dir):
    """Edges p + 1 -> p are added; those that would close a cycle do not ascend in order and go."""
    gd = A.gd_edges(spark, sf_dir)
    back = A.raw(spark, sf_dir, "part").where("p_partkey % 100 = 7").select((F.col("p_partkey") + 1).alias("from_det"), F.col("p_partkey").alias("to_det"))
    p = A.raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("id"))
    return G.acyclic_edges(gd.unionByName(back), p)


@query("SELECT count(*) AS nodes FROM (SELECT caller AS n FROM calls UNION SELECT callee FROM calls)")
def graph_node_count(spark, sf_dir):
    """D06, G01."""
    c = A.calls(spark, sf_dir)
    return c.select(F.col("caller").alias("n")).union(c.select("callee")).distinct().agg(F.count(F.lit(1)).alias("nodes"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path, define_name ORDER BY seq) AS i FROM det),
e AS (SELECT a.id AS f, b.id AS t FROM x a JOIN x b USING (project_id, file_path, define_name) WHERE b.i = a.i + 1 AND b.seq % 4 > 0)
SELECT project_id, file_path, define_name, bool_and(d >= 0.2) AS moving FROM (
 SELECT b.project_id, b.file_path, b.define_name, CASE WHEN e.f IS NULL THEN 1.0 ELSE 1.0 / (1 + (SELECT count(*) + 1 FROM x z WHERE z.project_id = b.project_id AND z.file_path = b.file_path AND z.define_name = b.define_name AND z.i < b.i - 1
   AND NOT EXISTS (SELECT 1 FROM x y WHERE y.project_id = b.project_id AND y.file_path = b.file_path AND y.define_name = b.define_name AND y.i > z.i AND y.i <= b.i - 1 AND y.seq % 4 = 0))) END AS d
 FROM x b LEFT JOIN e ON e.t = b.id WHERE b.i > 1 QUALIFY row_number() OVER (PARTITION BY b.project_id, b.file_path, b.define_name ORDER BY b.seq DESC) <= 3) GROUP BY ALL""")
def keeps_moving(spark, sf_dir):
    """E05 over version edges of which every fourth is missing: a version's ancestors are the unbroken run before it."""
    det = A.determinations(spark, sf_dir)
    pairs = C.adjacent_pairs(det)
    edges = pairs.join(det.where("seq % 4 > 0").select(F.col("id").alias("to_id")), "to_id").select(F.col("from_id").alias("f"), F.col("to_id").alias("t"))
    asked = pairs.where("back <= 3").select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))
    return C.keeps_moving(det, G.jaccard(G.closure(edges, "t", "f"), asked))
