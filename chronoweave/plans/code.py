"""Source code: a project of small modules is generated from parts, so that SQL knows its defines and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave import adapters as A
from chronoweave.operators.call_resolution import resolve_calls, with_return_types
from chronoweave.scratch import stored
from chronoweave.sources import js_source as J
from chronoweave.sources import python_source as P

from .registry import query

#: Part p - 1 gives module p: a class with two methods, a function that uses modules p div 2 and p div 3, and a stub.
_TEXT = """import pkg.m%1$d as low
from pkg.m%2$d import run as other, Box

class Box:
    limit: int = %3$d

    def __init__(self, size, *, step=1):
        self.size = size

    def grow(self, by=%3$d):
        self.size += by  # %4$s
        return self.check(by) and by > 1

    @staticmethod
    def check(x):
        return x

def run(a, b: int = 2, *args, **kwargs):
    box = Box(a)
    box.grow()
    low.run(a)
    other(b)
    if a not in args:
        raise ValueError(1.5)
    return helper_%5$d(box)

def helper_%5$d(x) -> Box:
    def inner():
        return unknown(x)
    return
"""


def _files(spark, sf_dir):
    p = A.raw(spark, sf_dir, "part").withColumn("p_partkey", F.col("p_partkey") + 1)
    text = F.format_string(_TEXT, F.floor(F.col("p_partkey") / 2).cast("long"), F.floor(F.col("p_partkey") / 3).cast("long"), "p_size", "p_name", "p_partkey")
    broken = F.when(F.col("p_partkey") % 97 == 0, F.concat(text, F.lit("\ndef broken(:\n"))).otherwise(text)
    return p.select(F.concat(F.lit("pkg/m"), "p_partkey", F.lit(".py")).alias("path"), broken.alias("text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


_OK = "ok AS (SELECT *, 'pkg/m' || p_partkey || '.py' AS path FROM (SELECT * REPLACE (p_partkey + 1 AS p_partkey) FROM part) WHERE p_partkey % 97 > 0)"


@query(f"""WITH {_OK} SELECT path, u.q AS qualified_name, CASE u.i WHEN 1 THEN 7 WHEN 2 THEN 10 WHEN 3 THEN 15 WHEN 4 THEN 18 ELSE 27 END::BIGINT AS start_line, CASE u.i WHEN 4 THEN 'run' WHEN 1 THEN 'none' WHEN 5 THEN 'bare' ELSE 'value' END AS kind,
CASE u.i WHEN 1 THEN '' WHEN 2 THEN 'self.check' WHEN 3 THEN '' WHEN 4 THEN 'Box,box.grow,low.run,other,ValueError,helper_' || p_partkey ELSE '' END AS calls,
CASE u.i WHEN 1 THEN '' WHEN 2 THEN 'And,AugAdd,Gt' WHEN 4 THEN 'NotIn' ELSE '' END AS operators, CASE u.i WHEN 1 THEN 'attr_write' WHEN 2 THEN 'attr_write' WHEN 4 THEN 'raises' ELSE '' END AS effects,
CASE u.i WHEN 1 THEN '1,0,false,false,1' WHEN 2 THEN '0,1,false,false,0' WHEN 3 THEN '1,0,false,false,0' WHEN 4 THEN '1,1,true,true,0' ELSE '1,0,false,false,0' END AS params
FROM ok, (VALUES (1, 'Box.__init__'), (2, 'Box.grow'), (3, 'Box.check'), (4, 'run'), (5, 'helper')) v(i, q0), LATERAL (SELECT i, CASE WHEN i = 5 THEN 'helper_' || p_partkey ELSE q0 END AS q) u""")
def py_defines(spark, sf_dir):
    rows = P.defines(_files(spark, sf_dir))
    p = F.col("params")
    shape = F.concat_ws(",", p["required"], p["defaults"], p["has_args"], p["has_kwargs"], p["keyword_only"])
    kind = F.when(F.col("qualified_name") == "run", "run").otherwise(F.col("returns_kind"))
    return rows.select("path", "qualified_name", "start_line", kind.alias("kind"), *[F.array_join(c, ",").alias(c) for c in ("calls", "operators", "effects")], shape.alias("params"))


@query(f"""WITH {_OK} SELECT name, count(*) AS defines, CASE name WHEN 'run' THEN count(*) ELSE 1 END AS coarse, CASE name WHEN 'run' THEN count(*) ELSE 1 END AS fine FROM ok, (VALUES ('Box.__init__'), ('Box.grow'), ('Box.check'), ('run'), ('helper')) v(name) GROUP BY 1""")
def fingerprints(spark, sf_dir):
    """The modules' functions are alike but for names and defaults, which do not count; run calls its own helper."""
    rows = P.fingerprints(P.defines(_files(spark, sf_dir))).withColumn("name", F.regexp_replace("qualified_name", r"_\d+$", ""))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("defines"), F.count_distinct("node_fingerprint").alias("coarse"), F.count_distinct("fine_fingerprint").alias("fine"))


@query(f"""WITH {_OK} SELECT path, 'low' AS name, 'pkg.m' || p_partkey // 2 AS target FROM ok UNION ALL SELECT path, 'other', 'pkg.m' || p_partkey // 3 || '.run' FROM ok UNION ALL SELECT path, 'Box', 'pkg.m' || p_partkey // 3 || '.Box' FROM ok""")
def imports(spark, sf_dir):
    return P.imports(_files(spark, sf_dir))


@query(f"""WITH {_OK}, e AS (SELECT p_partkey AS p, 'py::pkg.m' || p_partkey || '.' AS me, p_partkey // 2 AS lo, p_partkey // 3 AS th FROM ok), k AS (SELECT p FROM e)
SELECT me || 'run' AS caller, me || 'helper_' || p AS callee, 'call' AS edge_kind FROM e UNION SELECT me || 'Box.grow', me || 'Box.check', 'call' FROM e
UNION SELECT me || 'run', 'py::pkg.m' || lo || '.run', 'call' FROM e WHERE lo IN (SELECT p FROM k) UNION SELECT me || 'run', 'py::pkg.m' || th || '.run', 'call' FROM e WHERE th IN (SELECT p FROM k)
UNION SELECT me || 'run', CASE WHEN th IN (SELECT p FROM k) THEN 'py::pkg.m' || th || '.Box.grow' ELSE me || 'Box.grow' END, 'call' FROM e""")
def call_edges_resolved(spark, sf_dir):
    """2.N: box is a Box, which is imported, so its method is that of the module it comes from, if that is there."""
    files = stored(_files(spark, sf_dir))
    rows = P.defines(files).withColumn("lang", F.lit("py")).withColumn("module", F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", "."))
    found = P.imports(files)
    return resolve_calls(with_return_types(rows, found), found, P.reexports(files))


@query("SELECT 'pkg/m' || p_partkey + 1 || '.py' AS path, (p_partkey + 1) % 97 > 0 AS ok FROM part")
def parse_states(spark, sf_dir):
    return P.parse_state(_files(spark, sf_dir))


_SCRIPT = """import { run as other } from './m%1$d';
export const limit = %2$d;
export class Box extends Base<T> {
  items: Map<string, {n: number}> = new Map();
  get size(): number { return this.items.size; }
  async grow(by = %2$d, ...rest) { await this.load(by); this.items = by > 1; }
}
export const make_%3$d = useMemo(async (a, b?: number) => { return other(a) ?? `t ${b} }`; }, []);
function plain(x): { n: number } { if (x && /a{/.test(x)) { throw new Error('%4$s'); } return; }
"""


@query("""WITH o AS (SELECT *, 'm' || p_partkey || '.ts' AS path FROM part)
SELECT path, CASE i WHEN 4 THEN 'make_' || p_partkey ELSE q END AS qualified_name, CASE i WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 4 THEN 8 ELSE 9 END::BIGINT AS start_line, CASE i WHEN 1 THEN 'value' WHEN 4 THEN 'value' WHEN 2 THEN 'none' ELSE 'bare' END AS kind,
CASE i WHEN 2 THEN 'this.load' WHEN 4 THEN 'other' WHEN 5 THEN 'Error' ELSE '' END AS calls, CASE i WHEN 2 THEN '>' WHEN 4 THEN '||' WHEN 5 THEN '&&' ELSE '' END AS operators,
CASE i WHEN 2 THEN 'async,attr_write' WHEN 4 THEN 'async' WHEN 5 THEN 'raises' ELSE '' END AS effects, CASE i WHEN 1 THEN '0,0,false' WHEN 2 THEN '0,1,true' WHEN 4 THEN '1,1,false' ELSE '1,0,false' END AS params
FROM o, (VALUES (1, 'Box.get size'), (2, 'Box.grow'), (4, ''), (5, 'plain')) v(i, q)""")
def js_defines(spark, sf_dir):
    p = A.raw(spark, sf_dir, "part")
    text = F.format_string(_SCRIPT, F.floor(F.col("p_partkey") / 2).cast("long"), "p_size", "p_partkey", "p_name")
    files = p.select(F.concat(F.lit("m"), "p_partkey", F.lit(".ts")).alias("path"), text.alias("text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    s = F.col("params")
    rows = J.defines(files)
    return rows.select("path", "qualified_name", "start_line", F.col("returns_kind").alias("kind"), *[F.array_join(c, ",").alias(c) for c in ("calls", "operators", "effects")], F.concat_ws(",", s["required"], s["defaults"], s["has_args"]).alias("params"))
