"""Interval, nearest and prefix joins as equi joins on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import as_large


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, low: str, high: str, width: int = 256, open_low: bool = True) -> DataFrame:
    """Inner join of points with the spans that hold them: low < at <= high (or low <= at). A null high is unbounded.

    Both sides meet on by and a bin of the long column, so no task compares all points with all spans. Bins are `width`
    wide, or for longer spans the next power of two times that, so a span touches two bins at most, however long it is; a
    point goes to one bin of each width that occurs. These widths, 60 at most, reach the driver. Unbounded spans end at the
    points' largest value for the key.
    """
    top = points.groupBy(*by).agg(F.max(at).alias("_top"))
    spans = spans.join(top, by).withColumn("_end", F.least(F.coalesce(F.col(high), F.col("_top")), F.col("_top")))
    spans = spans.where(F.col("_end") >= F.col(low))
    spans = spans.withColumn("_size", (width * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2((F.col("_end") - F.col(low) + 1) / width))))).cast("long"))
    sizes = [r["_size"] for r in spans.select("_size").distinct().collect()]
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / F.col("_size")), F.floor(F.col("_end") / F.col("_size")))))
    rows = points.withColumn("_size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes]).cast("array<bigint>")))
    rows = rows.withColumn("_bin", F.floor(F.col(at) / F.col("_size"))).join(as_large(spans), [*by, "_size", "_bin"])
    above = F.col(at) > F.col(low) if open_low else F.col(at) >= F.col(low)
    return rows.where(above & (F.col(at) <= F.col("_end"))).drop("_bin", "_size", "_top", "_end")


def _neighbours(left: DataFrame, right: DataFrame, by: list[str], left_at: str, width: int) -> DataFrame:
    """(_row, _at, _p, _n): each left row with the last right row (by, _at, _v) not after it and the first not before it.

    For each bin of the long column the last row before and the first row after it are carried over from other bins in a
    table of one row for each bin; within a bin windows find neighbours. So a long sequence is spread over its bins, and
    the work is linear in both sides: what follows is read in descending order, since Spark computes a frame that ends with
    the partition anew for each row. Right rows are unique in (by, _at).
    """
    r = right.withColumn("_bin", F.floor(F.col("_at") / width))
    row = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns])).select(*by, F.col(left_at).alias("_at"), "_row").withColumn("_bin", F.floor(F.col("_at") / width))
    pair = F.struct("_at", "_v")
    bins = r.groupBy(*by, "_bin").agg(F.max(pair).alias("_hi"), F.min(pair).alias("_lo")).unionByName(row.select(*by, "_bin").distinct(), allowMissingColumns=True)
    bins = bins.groupBy(*by, "_bin").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    order, back = Window.partitionBy(*by).orderBy("_bin"), Window.partitionBy(*by).orderBy(F.desc("_bin"))
    others = (Window.unboundedPreceding, -1)
    bins = bins.select(*by, "_bin", F.last("_hi", True).over(order.rowsBetween(*others)).alias("_before"), F.last("_lo", True).over(back.rowsBetween(*others)).alias("_after"))
    both = r.withColumn("_pair", pair).unionByName(row, allowMissingColumns=True)
    inner, back = Window.partitionBy(*by, "_bin").orderBy("_at"), Window.partitionBy(*by, "_bin").orderBy(F.desc("_at"))
    up_to = (Window.unboundedPreceding, 0)
    both = both.withColumn("_p", F.last("_pair", True).over(inner.rangeBetween(*up_to)))
    both = both.withColumn("_n", F.last("_pair", True).over(back.rangeBetween(*up_to)))
    found = both.where("_row is not null").join(bins, [*by, "_bin"])
    return found.select("_row", "_at", F.coalesce("_p", "_before").alias("_p"), F.coalesce("_n", "_after").alias("_n"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, value: str, width: int) -> DataFrame:
    """Left with the value of the right row nearest in a long column (ties: the earlier one), null without any.
    Among right rows at one point the least value counts."""
    r = right.groupBy(*by, F.col(right_at).alias("_at")).agg(F.min(value).alias("_v"))
    found = _neighbours(left, r, by, left_at, width)
    earlier = F.col("_n").isNull() | (F.col("_at") - F.col("_p._at") <= F.col("_n._at") - F.col("_at"))
    best = F.when(F.col("_p").isNotNull() & earlier, F.col("_p._v")).otherwise(F.col("_n._v"))
    return found.select("_row.*", best.alias(value))


def latest(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, value: str, last: str, width: int = 4096) -> DataFrame:
    """As-of join: left with value and value_at, the value and place of the last right row not after it, null without any.
    Among right rows at one point that with the largest `last` counts."""
    r = right.groupBy(*by, F.col(right_at).alias("_at")).agg(F.max_by(value, last).alias("_v"))
    return _neighbours(left, r, by, left_at, width).select("_row.*", F.col("_p._v").alias(value), F.col("_p._at").alias(f"{value}_at"))


def longest_prefix(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root_path") -> DataFrame:
    """For each file the root that is its longest ancestor folder, or itself. Ancestors are exploded: an equi join."""
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = files.withColumn("_up", F.explode(ups)).join(roots.withColumnRenamed(root, "_up"), "_up")
    keep = [c for c in rows.columns if c not in files.columns and c != "_up"]
    packed = F.max_by(F.struct(F.col("_up").alias(root), *keep), F.length("_up")).alias("_best")
    return rows.groupBy(*files.columns).agg(packed).select(*files.columns, "_best.*")


def project_of(files: DataFrame, projects: DataFrame, path: str = "path") -> DataFrame:
    """For each file (path, branch) its project (project_id, root_path, branch): of the longest root that holds it, the
    one on the file's branch, else, or for a file without a branch, the one with the least id."""
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = projects.select("project_id", F.col("root_path").alias("_up"), F.coalesce("branch", F.lit("")).alias("_on"))
    rows = files.withColumn("_up", F.explode(ups)).join(known, "_up")
    fits = F.coalesce(F.col("branch").isNotNull() & (F.col("branch") == F.col("_on")), F.lit(False))
    best = F.max(F.struct(F.length("_up").alias("l"), fits.alias("f"), (-F.col("project_id")).alias("p"))).alias("_best")
    return rows.groupBy(*files.columns).agg(best).select(*files.columns, (-F.col("_best.p")).alias("project_id"))


def rounds_of(det: DataFrame, chain: list[str], last: int = 5) -> DataFrame:
    """The intervals (prev_seq, seq] of each chain's last versions, and the tail after the last one (round 0)."""
    order = Window.partitionBy(*chain).orderBy("seq")
    rows = det.select(*chain, "seq", F.coalesce(F.lag("seq").over(order), F.lit(0).cast("long")).alias("low"), F.row_number().over(Window.partitionBy(*chain).orderBy(F.desc("seq"))).alias("round"))
    rows = rows.where(F.col("round") <= last).select(*chain, F.col("round").cast("long"), "low", F.col("seq").alias("high"))
    tail = det.groupBy(*chain).agg(F.max("seq").alias("low")).select(*chain, F.lit(0).cast("long").alias("round"), "low", F.lit(None).cast("long").alias("high"))
    return rows.unionByName(tail)


def round_signatures(det: DataFrame, crashes: DataFrame, chain: list[str], last: int = 5) -> DataFrame:
    """For each round the last error signature of a crash of the project inside it, null without one.

    The last crash up to a round's end is found as of that end, and counts if it lies after the round's begin, so long
    rounds cost no more than short ones. The tail ends after everything.
    """
    spans = rounds_of(det, chain, last)
    seen = crashes.where("error_signature is not null and seq is not null").select("project_id", F.col("seq").alias("crash_seq"), F.col("id").alias("crash_id"), F.col("error_signature").alias("signature"))
    closed = latest(spans.where("high is not null"), seen, ["project_id"], "high", "crash_seq", "signature", "crash_id")
    final = seen.groupBy("project_id").agg(F.max_by(F.struct("signature", "crash_seq"), F.struct("crash_seq", "crash_id")).alias("f"))
    tails = spans.where("high is null").join(final, "project_id", "left").select(*spans.columns, F.col("f.signature").alias("signature"), F.col("f.crash_seq").alias("signature_at"))
    rows = closed.select(*spans.columns, "signature", "signature_at").unionByName(tails)
    return rows.withColumn("signature", F.when(F.col("signature_at") > F.col("low"), F.col("signature"))).drop("signature_at")


def error_evolution(rounds: DataFrame, chain: list[str]) -> DataFrame:
    """type1 if all earlier signatures equal the current one (the tail's), type2 if any differs, resolved if there is
    none now but was, no_data otherwise."""
    out = rounds.groupBy(*chain).agg(
        F.max(F.when(F.col("round") == 0, F.col("signature"))).alias("now"),
        F.min(F.when(F.col("round") > 0, F.col("signature"))).alias("least"),
        F.max(F.when(F.col("round") > 0, F.col("signature"))).alias("most"),
    )
    kind = F.when(F.col("now").isNull(), F.when(F.col("most").isNull(), "no_data").otherwise("resolved")).when(F.col("most").isNull(), "no_data").when((F.col("least") == F.col("now")) & (F.col("most") == F.col("now")), "type1").otherwise("type2")
    return out.select(*chain, kind.alias("evolution"))
