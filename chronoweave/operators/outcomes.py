"""Test outcomes over time, and how they meet changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import as_large

CASE = ["project_id", "classname", "name"]
FAILING = ("failed", "error")


def case_history(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Every case's results in order of the run's id."""
    rows = cases.join(as_large(runs.select(F.col("id").alias("test_run_id"), "project_id", "seq")), "test_run_id")
    at = Window.partitionBy(*CASE).orderBy("test_run_id")
    return rows.withColumn("place", F.row_number().over(at).cast("long"))


def _ends(history: DataFrame) -> DataFrame:
    """For each case its last result, and what came before: aggregates over the whole history."""
    bad = F.col("status").isin(*FAILING)
    return history.groupBy(*CASE).agg(
        F.max_by("status", "test_run_id").alias("last_status"),
        F.max("test_run_id").alias("last_run"),
        F.max_by("seq", "test_run_id").alias("last_seq"),
        F.count(F.lit(1)).alias("results"),
        F.min(F.when(F.col("status") == "passed", F.col("test_run_id"))).alias("first_pass"),
        F.min(F.when(bad, F.col("test_run_id"))).alias("first_fail"),
        F.max(F.when(bad, F.struct("test_run_id", "seq"))).alias("last_fail"),
    )


def green_to_red(history: DataFrame) -> DataFrame:
    """Cases that fail now and have passed before."""
    return _ends(history).where(F.col("last_status").isin(*FAILING) & (F.col("first_pass") < F.col("last_run"))).select(*CASE, "results")


def red_to_green(history: DataFrame) -> DataFrame:
    """Cases that pass now and have failed before."""
    return _ends(history).where((F.col("last_status") == "passed") & (F.col("first_fail") < F.col("last_run"))).select(*CASE, "results")


def last_red(history: DataFrame) -> DataFrame:
    """For cases that turned green, the run and seq of the last failure, and the seq of the final pass."""
    rows = _ends(history).where((F.col("last_status") == "passed") & (F.col("first_fail") < F.col("last_run")))
    return rows.select(*CASE, F.col("last_fail.test_run_id").alias("red_run"), F.col("last_fail.seq").alias("red_seq"), F.col("last_seq").alias("green_seq"))


def persistent_failure(history: DataFrame, association: DataFrame, spans: DataFrame) -> DataFrame:
    """(define key, failing) for defines with associated results in their edit window [first_seq, last_seq].

    association: (define_key, classname, name); spans: (define_key, project_id, first_seq, last_seq). True if no result of
    an associated case in the window is other than failing. The case key makes it an equi join, the window a filter.
    """
    rows = association.join(spans, "define_key").join(history, [*CASE])
    inside = rows.where(F.col("seq").between(F.col("first_seq"), F.col("last_seq")))
    return inside.groupBy("define_key").agg(F.every(F.col("status").isin(*FAILING)).alias("failing"), F.count(F.lit(1)).alias("results"))


def production_changes(windows: DataFrame, det: DataFrame, is_test) -> DataFrame:
    """Distinct defines of no test file changed in (low, high] of each window (window_id, project_id, low, high)."""
    from .intervals import within

    rows = det.where(F.col("define_name").isNotNull() & ~is_test).select("project_id", "seq", "file_path", "define_name")
    return within(rows, windows, ["project_id"], "seq", "low", "high").select("window_id", "project_id", "file_path", "define_name").distinct()


def covered(coverage: DataFrame) -> DataFrame:
    return coverage.select("project_id", "define_name").distinct()


def uncovered_ranked(summary: DataFrame, coverage: DataFrame, callers: DataFrame) -> DataFrame:
    """Defines no test covers, by number of callers, then versions, then key."""
    rows = summary.join(covered(coverage), ["project_id", "define_name"], "left_anti")
    rows = rows.join(callers, ["project_id", "file_path", "define_name"], "left").withColumn("callers", F.coalesce("callers", F.lit(0).cast("long")))
    return rows.select("project_id", "file_path", "define_name", "callers", "version_count")


def stale_covered(summary: DataFrame, coverage: DataFrame, history: DataFrame) -> DataFrame:
    """Covered defines of which every covering case last ran before the last edit, or never."""
    ran = history.groupBy("project_id", F.concat_ws("::", "classname", "name").alias("test_case")).agg(F.max("seq").alias("ran_seq"))
    rows = summary.join(coverage, ["project_id", "define_name"]).join(ran, ["project_id", "test_case"], "left")
    late = F.coalesce(F.col("ran_seq") < F.col("latest_seq"), F.lit(True))
    return rows.groupBy("project_id", "file_path", "define_name").agg(F.every(late).alias("stale"), F.count(F.lit(1)).alias("cases")).where("stale").drop("stale")
