"""The canonical tables, made from the star-schema test tables (see SURVEY 7.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ranks import as_large, global_rank


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def determinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: user and event type make a chain, user modulo 3 the project."""
    e = raw(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long")).withColumn("project_id", 1 + F.col("user_id") % 3)
    e = global_rank(e, ["project_id"], "event_id", "seq")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).withColumn("first", F.lit(True))
    e = e.join(first, ["user_id", "event_type", "event_id"], "left")
    text = lambda c: c.cast("string")
    return e.select(
        (F.col("event_id") + 1).alias("id"), "project_id", "seq", F.concat(F.lit("src/m"), "user_id", F.lit(".py")).alias("file_path"),
        F.col("event_type").alias("define_name"), "k", text(F.col("k") % 20).alias("node_fingerprint"), text(F.col("k") % 40).alias("fine_fingerprint"),
        text(F.col("k")).alias("content_hash"), F.col("ts").alias("created_at"), "user_id",
        F.when(F.col("first"), "create").when(F.col("k") >= 95, "delete").otherwise("modify").alias("edit_type"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What determinations say without a place in the order or a kind, which cost a rank and two joins."""
    return raw(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("id"), F.concat(F.lit("src/m"), "user_id", F.lit(".py")).alias("file_path"), F.col("event_type").alias("define_name"), "user_id")


def gd_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DAG over parts: from p div 2 and p div 3 to p."""
    p = raw(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey")
    two, three = (p.select(F.floor(F.col("p_partkey") / n).cast("long").alias("from_det"), F.col("p_partkey").alias("to_det")) for n in (2, 3))
    return two.unionByName(three).distinct()


def gd_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the edges p div 2 -> p those within one brand."""
    p = raw(spark, sf_dir, "part").select("p_partkey", "p_brand")
    up = p.select(F.col("p_partkey").alias("from_det"), F.col("p_brand").alias("b"))
    child = p.where("p_partkey > 0").withColumn("from_det", F.floor(F.col("p_partkey") / 2).cast("long"))
    return child.join(up, "from_det").where("p_brand = b").select("from_det", F.col("p_partkey").alias("to_det"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges in the DAG's shape: a part calls the parts that it depends on."""
    return gd_edges(spark, sf_dir).select(F.col("to_det").alias("caller"), F.col("from_det").alias("callee"))


def hub_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges with hubs: parts call suppliers."""
    return raw(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee")).distinct()


def test_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).cast("long").alias("project_id"), F.col("o_orderkey").alias("seq"))


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "passed").when(F.col("o_orderstatus") == "F", "failed").otherwise("skipped")
    return raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_run_id"), F.concat(F.lit("tests.C"), "o_custkey").alias("classname"), F.col("o_orderpriority").alias("name"), status.alias("status"))


def sessions(spark: SparkSession, sf_dir: str, length: int = 100) -> DataFrame:
    """Blocks of 100 events of a project; the last one is open."""
    top = determinations(spark, sf_dir).groupBy("project_id").agg(F.max("seq").alias("top"))
    rows = top.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("top") - 1) / length))))
    low = F.col("n") * length
    return rows.select("project_id", F.concat_ws("-", F.lit("s"), "project_id", "n").alias("session_id"), low.alias("start_seq"), F.when(low + length < F.col("top"), low + length).alias("end_seq"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and views of a user are covered by the cases of the customer of that number."""
    c = raw(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    e = raw(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    rows = c.join(as_large(e.where("event_type in ('purchase', 'view')")), c.o_custkey == e.user_id)
    return rows.select((1 + F.col("user_id") % 3).alias("project_id"), F.concat(F.lit("src/m"), "user_id", F.lit(".py")).alias("file_path"), F.col("event_type").alias("define_name"), F.concat(F.lit("tests.C"), "o_custkey").alias("classname"), F.col("o_orderpriority").alias("name"))


def crashes(spark: SparkSession, sf_dir: str, det: DataFrame | None = None) -> DataFrame:
    """Every error event is a crash of its project, its signature from the value. det: the log, if it is at hand."""
    d = (determinations(spark, sf_dir) if det is None else det).where("define_name = 'error'")
    kind = F.when(F.col("k") % 3 == 0, "TypeError|undefined").when(F.col("k") % 3 == 1, "KeyError|missing")
    return d.select("id", "project_id", "seq", kind.alias("error_signature"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth k is an incident on its event's chain; signal and state go round."""
    d = determinations(spark, sf_dir).where("k % 10 = 0")
    e = F.col("id") - 1
    signal = F.when(e % 3 == 0, "stuck_region").when(e % 3 == 1, "debug_loop").otherwise("define_loop")
    n = F.floor(F.col("k") / 10) % 4
    state = F.when(n == 0, "open").when(n == 1, "notified_agent").when(n == 2, "escalated_user").otherwise("resolved")
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    return d.select(e.alias("id"), "project_id", signal.alias("signal"), F.concat_ws("::", "file_path", "define_name").alias("target_node"), state.alias("state"), at.alias("created_us"), (at + F.col("k") * 60_000_000).alias("updated_us"))
