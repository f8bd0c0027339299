"""Event rounds as micro-batches.

A stream of hook events is read from JSON files, deduplicated within a watermark, and handed round by round to the same
DataFrame stages that batch jobs use. The state machine of incidents runs as a stateful operator whose step is a plain
function; tests hold it against the batch fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.operators.escalation import INTEGRITY, QUIET_ROUNDS, STATE_BASED, THETA
from chronoweave.operators.reconcile import Seen

#: A hook event: what happened, where, in which project and session.
EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("project_id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("stop_active", T.BooleanType()),
        T.StructField("at", T.TimestampType()),
    ]
)
KINDS = ("post_edit", "post_read", "post_bash", "session_start", "stop", "metrics")


def hook_events(spark: SparkSession, folder: str, files_per_round: int = 100) -> DataFrame:
    """Events dropped as JSON files; malformed lines and unknown kinds go, as does a stop within a stop."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_round).json(folder)
    return rows.where(F.col("kind").isin(*KINDS) & ~((F.col("kind") == "stop") & F.coalesce("stop_active", F.lit(False))))


def once(events: DataFrame, key: list[str], at: str = "at", window: str = "120 seconds") -> DataFrame:
    """2.Q: the first event of each key within the window; state older than the watermark is dropped."""
    return events.withWatermark(at, window).dropDuplicatesWithinWatermark(key)


def run_rounds(events: DataFrame, stage: Callable[[DataFrame, int], None], checkpoint: str, once_only: bool = True, mode: str = "append") -> StreamingQuery:
    """L1: stage(batch, round) for each micro-batch; a round that failed is repeated whole, so stages must be idempotent
    in their round's number."""
    writer = events.writeStream.outputMode(mode).foreachBatch(stage).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_only else writer.trigger(processingTime="5 seconds")).start()


def whole_rounds(folder: str, see: Callable[[DataFrame], Seen]) -> Callable[[DataFrame, int], None]:
    """The stage of a round with all its rules (operators.reconcile): see(batch) says what a batch of events looked
    at. Round n reads the tables that round n - 1 left in its folder and overwrites its own, so repeating it is harmless."""
    from chronoweave.operators import reconcile as whole

    def stage(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = whole.empty(spark)
        names = ("log", "calls", "edges", "incidents", "messages")
        if number:
            before = whole.Tables(*(spark.read.schema(getattr(before, n).schema).parquet(f"{folder}/round={number - 1}/{n}") for n in names))
        after, net, assist = whole.round_(before, see(batch), number)
        for name, df in (*((n, getattr(after, n)) for n in names), ("net", net), ("assist", assist)):
            df.write.mode("overwrite").parquet(f"{folder}/round={number}/{name}")

    return stage


def reconcile(log: str, incidents: str, defines_of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """The stage of a round over Parquet tables: the changed files' defines become events of the log, numbered in
    order, and rules over the log open incidents that are not open yet.

    defines_of gives (project_id, file_path, define_name, content_hash, node_fingerprint, fine_fingerprint) of a batch of
    events (project_id, path); files without defines are deleted ones. A round writes to folders of its own number with
    overwrite, and reads those of smaller numbers, so repeating a round after a failure gives the same tables.
    """
    from chronoweave.operators import chains, detectors, maintenance

    def before(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
        try:
            rows = spark.read.schema(f"{schema}, round long").parquet(path)
        except AnalysisException:
            return spark.createDataFrame([], schema)
        return rows.where(F.col("round") < number).drop("round")

    def stage(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = batch.where("kind = 'post_edit'").select("project_id", F.col("path").alias("file_path")).distinct()
        old = before(spark, log, LOG, number)
        now = defines_of(batch)
        events = maintenance.capture(old, now, files)
        prints = now.select(*chains.CHAIN, "node_fingerprint", "fine_fingerprint")
        new = maintenance.numbered(events, old, ["file_path", "define_name"]).join(prints, chains.CHAIN, "left")
        new = new.withColumn("id", F.col("seq")).withColumn("created_at", F.lit(None).cast("timestamp"))
        columns = [c.split(" ")[0] for c in LOG.split(", ")]
        new.select(*columns).write.mode("overwrite").parquet(f"{log}/round={number}")
        every = old.select(*columns).unionByName(before(spark, log, LOG, number + 1).select(*columns)).distinct()
        known = before(spark, incidents, INCIDENTS, number)
        stuck = detectors.stuck_region(chains.stuck(every), spark.createDataFrame([], "project_id long, target_node string"))
        loops = chains.loop_back(every).select("project_id", F.lit("define_loop").alias("signal"), F.concat_ws("::", "file_path", "define_name").alias("target_node"))
        found = detectors.new_only(detectors.all_signals(stuck, loops), known).withColumn("state", F.lit("open"))
        found.write.mode("overwrite").parquet(f"{incidents}/round={number}")

    return stage


LOG = "id long, project_id long, seq long, file_path string, define_name string, node_fingerprint string, fine_fingerprint string, content_hash string, edit_type string, created_at timestamp"
INCIDENTS = "project_id long, signal string, target_node string, state string"


def effective(level: str, signal: str, theta: int) -> int | None:
    """Recurrences until the user is told; None: never. The same table as operators.escalation.effective_theta."""
    lower = max(1, theta - 1)
    if signal in INTEGRITY:
        return lower if level == "high" else theta
    return {"high": lower, "medium": theta, "low": theta + 2}.get(level)


State = tuple[str, int, int, int, int]
OPENED: State = ("open", 0, 0, 0, 0)


def advance(state: State, recurred: bool, signal: str, level: str, direct: bool) -> State:
    """2.K: (state, recurrences, quiet rounds, messages to the agent, to the user) after a round."""
    name, count, stable, agent, user = state
    if name == "resolved":
        return state
    if name == "open":
        if direct and effective(level, signal, 1) is not None:
            return "escalated_user", count, stable, agent, user + 1
        return "notified_agent", count, stable, agent + 1, user
    if recurred:
        if name == "escalated_user":
            return name, count, 0, agent, user
        limit = effective(level, signal, THETA.get(signal, 2))
        if limit is not None and count + 1 >= limit:
            return "escalated_user", count + 1, 0, agent, user + 1
        return name, count + 1, 0, agent + 1, user
    if signal in STATE_BASED:
        return "resolved", count, stable, agent, user
    return ("resolved" if stable + 1 >= QUIET_ROUNDS else name), count, stable + 1, agent, user


STATE = "state string, count int, stable int, agent int, user int"
OUT = "incident long, signal string, state string, count int, stable int, agent int, user int"


def escalated(rounds: DataFrame) -> DataFrame:
    """2.K, 2.Q: a stream of rounds (incident, signal, level, direct, round, recurred) to the state of each incident after
    every micro-batch that touched it. Resolved incidents keep their state, so late rounds change nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("round")
        now: State = tuple(held.get) if held.exists else OPENED
        for r in rows.itertuples():
            now = advance(now, bool(r.recurred), key[1], r.level, bool(r.direct))
        held.update(now)
        yield pd.DataFrame([(key[0], key[1], *now)], columns=["incident", "signal", "state", "count", "stable", "agent", "user"])

    return rounds.groupBy("incident", "signal").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
