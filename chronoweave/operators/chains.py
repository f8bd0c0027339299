"""Version chains: all change events of one (project, file, define), in order of seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ranks import last_row, top_rows

CHAIN = ["project_id", "file_path", "define_name"]

#: Rules: chain length, gap of a loop, agent's and user's streak.
STUCK_LENGTH, LOOP_GAP, STREAK_AGENT, STREAK_USER = 5, 2, 5, 8
#: Rules: adjacent pairs, least distance between neighbours.
PAIRS, DISTANCE = 3, 0.2


def _ordered() -> WindowSpec:
    return Window.partitionBy(*CHAIN).orderBy("seq")


def version_chain(det: DataFrame) -> DataFrame:
    """Every event with its place in the chain; deletions are versions too."""
    return det.withColumn("version", F.row_number().over(_ordered()).cast("long"))


def current_version(det: DataFrame) -> DataFrame:
    """The last event of each chain, which may be a deletion."""
    return last_row(det, CHAIN, "seq", ["id", "seq", "edit_type", "content_hash", "node_fingerprint", "fine_fingerprint"])


def as_of(det: DataFrame, seq: int, live_only: bool = True) -> DataFrame:
    """The last event of each chain up to seq, without those deleted then; a null hash counts as empty."""
    rows = current_version(det.where(F.col("seq") <= seq))
    rows = rows.withColumn("content_hash", F.coalesce("content_hash", F.lit("")))
    return rows.where("edit_type <> 'delete'") if live_only else rows


def snapshot_diff(det: DataFrame, before: int, after: int) -> DataFrame:
    """Chains added, removed or changed in content between two points of the order.

    One aggregate gives both states, so the log is read and shuffled once and there is no full outer join.
    """
    state = F.struct("edit_type", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    early = F.col("seq") <= before
    both = det.where(F.col("seq") <= max(before, after)).groupBy(*CHAIN).agg(
        F.max_by(F.when(early, state), F.when(early, F.col("seq"))).alias("a"),
        F.max_by(F.when(F.col("seq") <= after, state), F.when(F.col("seq") <= after, F.col("seq"))).alias("b"),
    )
    a, b = (F.when(F.col(f"{x}.edit_type") != "delete", F.col(f"{x}.content_hash")) for x in ("a", "b"))
    both = both.select(*CHAIN, a.alias("before_hash"), b.alias("after_hash"))
    change = F.when(F.col("before_hash").isNull(), "added").when(F.col("after_hash").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("before_hash").eqNullSafe(F.col("after_hash"))).withColumn("change", change)


def resolve_snapshot(snapshots: DataFrame, prefix: str, newest: int = 200) -> DataFrame:
    """For each project the newest snapshot (project_id, id, commit_hash, taken_at) whose commit begins with the
    prefix, among its newest ones."""
    order = [F.desc("taken_at"), F.desc("id")]
    return top_rows(top_rows(snapshots, ["project_id"], order, newest).where(F.col("commit_hash").startswith(prefix)), ["project_id"], order, 1)


def diff_commits(det: DataFrame, snapshots: DataFrame, before: str, after: str) -> DataFrame:
    """What changed in each project between the snapshots of two commits given by prefix; projects without either
    have no row. As snapshot_diff, but each project has its own two points (snapshot_at_seq)."""
    points = [resolve_snapshot(snapshots, p).select("project_id", F.col("snapshot_at_seq").alias(name)) for p, name in ((before, "_a"), (after, "_b"))]
    rows = det.join(F.broadcast(points[0].join(points[1], "project_id")), "project_id")  # a row for each project
    state = F.struct("edit_type", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    at = lambda point: F.max_by(F.when(F.col("seq") <= F.col(point), state), F.when(F.col("seq") <= F.col(point), F.col("seq")))
    both = rows.groupBy(*CHAIN).agg(at("_a").alias("a"), at("_b").alias("b"))
    both = both.select(*CHAIN, *[F.when(F.col(f"{x}.edit_type") != "delete", F.col(f"{x}.content_hash")).alias(n) for x, n in (("a", "before_hash"), ("b", "after_hash"))])
    change = F.when(F.col("before_hash").isNull(), "added").when(F.col("after_hash").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("before_hash").eqNullSafe(F.col("after_hash"))).withColumn("change", change)


def define_summary(det: DataFrame) -> DataFrame:
    """Last seq, versions and last id of each chain with a define."""
    return det.where("define_name is not null").groupBy(*CHAIN).agg(F.max("seq").alias("latest_seq"), F.count(F.lit(1)).alias("version_count"), F.max_by("id", "seq").alias("latest_id"))


def changed_since(det: DataFrame, seq: int) -> DataFrame:
    """Defines changed after seq, with their last change."""
    return det.where((F.col("seq") > seq) & F.col("define_name").isNotNull()).groupBy(*CHAIN).agg(F.max("seq").alias("last_seq"))


def distinct_fingerprints(det: DataFrame) -> DataFrame:
    """Whether all non-null coarse fingerprints of a chain differ."""
    out = det.groupBy(*CHAIN).agg(F.count("node_fingerprint").alias("n"), F.count_distinct("node_fingerprint").alias("different"))
    return out.withColumn("all_distinct", F.col("n") == F.col("different"))


def _returns(det: DataFrame) -> DataFrame:
    """Every event with its index in the chain and the first index of its (coarse, fine) fingerprint."""
    rows = det.withColumn("idx", F.row_number().over(_ordered()) - 1)
    key = Window.partitionBy(*CHAIN, "node_fingerprint", "fine_fingerprint").orderBy("idx")
    same = key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("first_idx", F.first("idx").over(same)).withColumn("first_seq", F.first("seq").over(same))


def loop_back(det: DataFrame, gap: int = LOOP_GAP) -> DataFrame:
    """For each chain the first event, in order, whose fingerprints occurred at least `gap` events earlier.

    Events without a coarse fingerprint are skipped, but count as events.
    """
    hits = _returns(det).where(F.col("node_fingerprint").isNotNull() & (F.col("idx") - F.col("first_idx") >= gap))
    best = F.min_by(F.struct(F.col("first_seq").alias("earlier_seq"), F.col("seq").alias("later_seq"), F.col("node_fingerprint").alias("fingerprint")), "idx")
    return hits.groupBy(*CHAIN).agg(best.alias("r")).select(*CHAIN, "r.earlier_seq", "r.later_seq", "r.fingerprint")


def latest_loops(det: DataFrame, gap: int = LOOP_GAP) -> DataFrame:
    """Chains whose last event returns to fingerprints of an event at least `gap` earlier."""
    rows = _returns(det).withColumn("last", F.max("idx").over(Window.partitionBy(*CHAIN)))
    return rows.where((F.col("idx") == F.col("last")) & F.col("node_fingerprint").isNotNull() & (F.col("idx") - F.col("first_idx") >= gap)).select(*CHAIN, "seq", "node_fingerprint")


def head_streak(det: DataFrame) -> DataFrame:
    """For each project the define of its last event and how many of the last events in a row are on it.

    Counting needs the last event on another define: two aggregates by project, and a count of what follows.
    """
    head = last_row(det, ["project_id"], "seq", ["project_id", "file_path", "define_name"])
    head = head.select("project_id", F.col("file_path").alias("head_file"), F.col("define_name").alias("head_define"))
    same = F.col("file_path").eqNullSafe(F.col("head_file")) & F.col("define_name").eqNullSafe(F.col("head_define"))
    rows = det.join(head, "project_id").withColumn("same", same)
    other = rows.groupBy("project_id").agg(F.coalesce(F.max(F.when(~F.col("same"), F.col("seq"))), F.lit(-1).cast("long")).alias("other_seq"))
    after = rows.join(other, "project_id").where(F.col("seq") > F.col("other_seq"))
    return after.groupBy("project_id", "head_file", "head_define").agg(F.count(F.lit(1)).alias("streak")).select("project_id", F.col("head_file").alias("file_path"), F.col("head_define").alias("define_name"), "streak")


def adjacent_pairs(det: DataFrame) -> DataFrame:
    """Neighbours in each chain, numbered from the last pair: (…, from_id, to_id, back)."""
    rows = det.withColumn("from_id", F.lag("id").over(_ordered())).withColumn("back", F.row_number().over(Window.partitionBy(*CHAIN).orderBy(F.desc("seq"))))
    return rows.where("from_id is not null").select(*CHAIN, "from_id", F.col("id").alias("to_id"), F.col("back").cast("long").alias("back"))


def keeps_moving(det: DataFrame, distances: DataFrame, pairs: int = PAIRS, least: float = DISTANCE) -> DataFrame:
    """Whether the last `pairs` neighbours of a chain all have a distance of at least `least`; false without pair.

    distances: (u, v, distance) of the pairs that have common ancestors; others are at distance 1.
    """
    near = adjacent_pairs(det).where(F.col("back") <= pairs)
    near = near.join(distances.select(F.col("u").alias("from_id"), F.col("v").alias("to_id"), "distance"), ["from_id", "to_id"], "left")
    return near.groupBy(*CHAIN).agg(F.every(F.coalesce("distance", F.lit(1.0)) >= least).alias("moving"))


def stuck(det: DataFrame, distances: DataFrame | None = None, length: int = STUCK_LENGTH) -> DataFrame:
    """Chains of at least `length` events, all coarse fingerprints different, whose last steps keep moving.

    Without distances (no edges between superseded versions) every neighbour is at distance 1, so E05 holds.
    """
    rows = distinct_fingerprints(det).join(define_summary(det), CHAIN).where((F.col("version_count") >= length) & F.col("all_distinct"))
    if distances is not None:
        rows = rows.join(keeps_moving(det, distances).where("moving"), CHAIN, "left_semi")
    return rows.select(*CHAIN, "version_count")


def edit_span(det: DataFrame) -> DataFrame:
    """Hours from a chain's first to its last event, to one decimal, halves to even."""
    seconds = (F.unix_micros(F.max("created_at").cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))) / 1e6
    return det.groupBy(*CHAIN).agg(F.bround(seconds / 3600, 1).alias("hours"))


def cluster_stability(det: DataFrame, since: int, current_files: DataFrame, window: int = 5) -> DataFrame:
    """For each project whether the defines changed since a commit, outside the current files, rest for `window` events."""
    top = det.groupBy("project_id").agg(F.max("seq").alias("max_seq"))
    others = changed_since(det, since).join(current_files, ["project_id", "file_path"], "left_anti")
    last = others.groupBy("project_id").agg(F.max("last_seq").alias("cluster_seq"))
    return last.join(top, "project_id").withColumn("stable", F.col("max_seq") - F.col("cluster_seq") >= window)
