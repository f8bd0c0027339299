"""The state machine of incidents, as a fold over rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals about the work's integrity; the others are about efficiency.
INTEGRITY = ("test_tampering", "boundary_breach", "task_scope_breach")
#: Signals that are resolved as soon as they do not recur.
STATE_BASED = ("test_tampering",)
#: Recurrences after which the user is told, by signal; other signals: 2.
THETA = {"stuck_region": 3, "debug_loop": 3, "regression": 2, "define_loop": 2, "task_scope_breach": 1, "boundary_breach": 1, "test_tampering": 1, "dangling_reference": 2}
QUIET_ROUNDS = 2
OPENED_STATES = ("open", "notified_agent", "escalated_user")


def base_theta(signal: Column) -> Column:
    out = F.lit(2)
    for name, n in THETA.items():
        out = F.when(signal == name, F.lit(n)).otherwise(out)
    return out


def effective_theta(level: Column, signal: Column, theta: Column) -> Column:
    """Recurrences until the user is told at this notification level; null: never."""
    lower = F.greatest(F.lit(1), theta - 1)
    integrity = F.when(level == "high", lower).otherwise(theta)
    efficiency = F.when(level == "high", lower).when(level == "medium", theta).when(level == "low", theta + 2)
    return F.when(signal.isin(*INTEGRITY), integrity).otherwise(efficiency)


def step(s: Column, recurred: Column, signal: Column, level: Column, direct: Column) -> Column:
    """The state after a round. s: struct(state, count, stable, agent, user), where agent and user count messages."""
    eff = effective_theta(level, signal, base_theta(signal))
    eff_direct = effective_theta(level, signal, F.lit(1))
    state, count, stable = s["state"], s["count"], s["stable"]
    opened, told, escalated = state == "open", state == "notified_agent", state == "escalated_user"
    to_user = (opened & direct & eff_direct.isNotNull()) | (told & recurred & eff.isNotNull() & (count + 1 >= eff))
    to_agent = (opened & ~(direct & eff_direct.isNotNull())) | (told & recurred & (eff.isNull() | (count + 1 < eff)))
    quiet = (told | escalated) & ~recurred
    resolved = quiet & (signal.isin(*STATE_BASED) | (stable + 1 >= QUIET_ROUNDS))
    return F.struct(
        F.when(resolved, "resolved").when(to_user, "escalated_user").when(opened, "notified_agent").otherwise(state).alias("state"),
        F.when(told & recurred, count + 1).otherwise(count).cast("int").alias("count"),
        F.when((told | escalated) & recurred, 0).when(quiet & ~signal.isin(*STATE_BASED), stable + 1).otherwise(stable).cast("int").alias("stable"),
        (s["agent"] + F.coalesce(to_agent, F.lit(False)).cast("int")).cast("int").alias("agent"),
        (s["user"] + F.coalesce(to_user, F.lit(False)).cast("int")).cast("int").alias("user"),
    )


def opened() -> Column:
    zero = lambda name: F.lit(0).cast("int").alias(name)
    return F.struct(F.lit("open").alias("state"), zero("count"), zero("stable"), zero("agent"), zero("user"))


def fold(rounds: DataFrame, by: list[str]) -> DataFrame:
    """2.K: the state of each incident after its rounds.

    rounds: by, signal, level, direct, round, recurred. All rounds of an incident are folded in order by one expression
    inside the JVM; a group is one incident's rounds.
    """
    seen = rounds.groupBy(*by, "signal", "level", "direct").agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "recurred"))), lambda x: x["recurred"]).alias("_r"))
    out = seen.withColumn("_s", F.aggregate("_r", opened(), lambda s, r: step(s, r, F.col("signal"), F.col("level"), F.col("direct"))))
    return out.select(*by, "signal", "level", "direct", F.size("_r").cast("long").alias("rounds"), "_s.state", *[F.col(f"_s.{c}").cast("long").alias(c) for c in ("count", "stable", "agent", "user")])
