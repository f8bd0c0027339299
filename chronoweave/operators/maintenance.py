"""Change capture, upserts, retention, queues: how tables follow new input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.schemas import ENUMS
from chronoweave.scratch import stored

from .chains import CHAIN, current_version
from .ranks import global_rank


def capture(det: DataFrame, current: DataFrame, files: DataFrame | None = None, repeat_deletes: bool = False) -> DataFrame:
    """The events that bring the log up to the current defines (CHAIN, content_hash).

    create for chains never seen, modify where the content differs, delete for chains that are gone from the scanned files
    (project_id, file_path; default: all). A deleted chain that comes back is created; with repeat_deletes it is modified,
    and a chain still gone is deleted anew, as an event log without a look at the last event's type would do.
    """
    last = current_version(det).select(*CHAIN, F.col("edit_type").alias("was_type"), F.coalesce("content_hash", F.lit("")).alias("was"))
    if files is not None:
        last = last.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_semi")
    now = current.select(*CHAIN, F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.lit(True).alias("here"))
    both = last.join(now, CHAIN, "full_outer")
    known = F.col("was_type").isNotNull() if repeat_deletes else F.col("was_type").isNotNull() & (F.col("was_type") != "delete")
    kind = F.when(F.col("here").isNull(), F.when(known, "delete")).when(~known, "create").when(F.col("was") != F.col("content_hash"), "modify")
    return both.select(*CHAIN, "content_hash", kind.alias("edit_type")).where("edit_type is not null")


def numbered(events: DataFrame, det: DataFrame, order: list[str]) -> DataFrame:
    """Events with the next seqs of their projects, in order of the given columns.

    Two levels: each range of the order is counted, and a row's rank is the count of the ranges before it and its rank
    within; so a project that holds most events is spread over as many tasks as there are ranges.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(events.repartitionByRange(parts, "project_id", *order).withColumn("_bin", F.spark_partition_id()))
    counts = ranged.groupBy("project_id", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("project_id", "_bin", (F.sum("_n").over(Window.partitionBy("project_id").orderBy("_bin")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("project_id", "_bin").orderBy(*order))
    top = det.groupBy("project_id").agg(F.max("seq").alias("_top"))
    rows = ranged.withColumn("_n", rank).join(counts, ["project_id", "_bin"]).join(top, "project_id", "left")
    return rows.withColumn("seq", (F.coalesce("_top", F.lit(0)) + F.col("_before") + F.col("_n")).cast("long")).drop("_n", "_top", "_bin", "_before")


def ingested(current: DataFrame, head: str, branch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, snapshots) of a project's first full ingest: a create for every define (CHAIN, content_hash), numbered
    by file and define, and a snapshot of the commit at its end. One job, whatever the number of files."""
    events = current.select(*CHAIN, "content_hash").withColumn("edit_type", F.lit("create"))
    events = numbered(events, events.limit(0).withColumn("seq", F.lit(0).cast("long")), ["file_path", "define_name"])
    marks = events.groupBy("project_id").agg(F.max("seq").alias("snapshot_at_seq"))
    return events, marks.select("project_id", F.lit(head).alias("commit_hash"), F.lit(branch).cast("string").alias("branch"), "snapshot_at_seq", F.lit("initial").alias("reason"))


def upserted(table: DataFrame, rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The table after rows replaced those of the same key; of several the highest version stays."""
    every = table.unionByName(rows)
    return every.groupBy(*key).agg(F.max_by(F.struct(*every.columns), version).alias("_r")).select("_r.*")


def appended(table: DataFrame, rows: DataFrame, key: list[str], first: str) -> DataFrame:
    """The table with those rows whose key it does not hold; of several the one with the least `first`."""
    new = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), first).alias("_r")).select("_r.*")
    return table.unionByName(new.join(table.select(*key), key, "left_anti"))


def replaced(table: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """The table after all its rows of the given keys (source files) gave way to rows."""
    return table.join(rows.select(*by).distinct(), by, "left_anti").unionByName(rows)


def kept(table: DataFrame, by: list[str], newest: str, k: int, width: int = 4096) -> DataFrame:
    """The newest k rows of each key by a unique long column. Counting from the end in two levels spreads a key
    that holds most rows."""
    rows = global_rank(table.withColumn("_back", -F.col(newest)), by, "_back", "_place", width)
    return rows.where(F.col("_place") <= k).drop("_back", "_place")


def equivalence_classes(det: DataFrame, node: Column) -> DataFrame:
    """Fine fingerprint and the live defines that have it, by their last version."""
    live = current_version(det).where("edit_type <> 'delete' and fine_fingerprint is not null")
    return live.groupBy("project_id", F.col("fine_fingerprint").alias("class_key")).agg(F.count(F.lit(1)).alias("members"), F.min(node).alias("least"))


def not_repeated(rows: DataFrame, key: list[str], at: str, seconds: float) -> DataFrame:
    """B08, 2.Q: rows without another of the same key in the `seconds` before (timestamps in the column at)."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    order = Window.partitionBy(*key).orderBy(micros)
    return rows.withColumn("_before", F.lag(micros).over(order)).where(F.col("_before").isNull() | (micros - F.col("_before") > seconds * 1_000_000)).drop("_before")


def recent(rows: DataFrame, at: str, now: str, seconds: int) -> DataFrame:
    """Rows at most `seconds` older than now, which is given, so results can be repeated."""
    return rows.where(F.col(at).cast("timestamp") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def taken(queue: DataFrame, channel: str) -> tuple[DataFrame, DataFrame]:
    """2.Q, P02: (messages to hand out, those that stay): untaken ones of a channel go, in order of id."""
    mine = (F.col("channel") == channel) & F.col("taken_at").isNull()
    return queue.where(mine), queue.where(~mine)


def queued(queue: DataFrame, files: DataFrame) -> DataFrame:
    """2.Q: the work queue (project_id, file_path, status) after files were put in: each once, done ones pending again."""
    both = queue.select("project_id", "file_path", "status").unionByName(files.select("project_id", "file_path", F.lit("pending").alias("status")))
    return both.groupBy("project_id", "file_path").agg(F.max("status").alias("status"))


def checked(rows: DataFrame, column: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with an allowed value, the others): what a column check would do, as quarantine."""
    fine = F.coalesce(F.col(column).isin(*ENUMS[kind or column]), F.lit(False))
    return rows.where(fine), rows.where(~fine)
