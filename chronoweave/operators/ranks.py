"""Ranks and running values over long sequences without one task for a whole sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_large(df: DataFrame) -> DataFrame:
    """df for the right side of an equi join that grows with the log. Spark's estimate is that of compressed files, so it would
    broadcast millions of rows, which the driver must hold; this side is shuffled and sorted instead."""
    return df.hint("merge")


def global_rank(df: DataFrame, by: list[str], order: str, name: str, width: int = 4096) -> DataFrame:
    """df with the rank, from 1, of each row within `by` in ascending order of a long column that is unique there.

    Two levels: counts of ranges of the order column, a few rows for each, give each range's first rank; rows are ranked
    within their range only. So a key that holds most rows is spread over as many tasks as it has ranges.
    """
    bins = df.withColumn("_bin", F.floor(F.col(order) / width))
    counts = bins.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    first = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin")) - F.col("_n")
    counts = counts.select(*by, "_bin", first.alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(order))
    ranked = bins.withColumn("_rank", rank).join(counts, [*by, "_bin"])
    return ranked.withColumn(name, (F.col("_first") + F.col("_rank")).cast("long")).drop("_bin", "_rank", "_first")


def last_row(df: DataFrame, by: list[str], order: Column | str, columns: list[str]) -> DataFrame:
    """For each key the columns of its last row by order: an aggregate, so partial sums run before the shuffle."""
    packed = F.max_by(F.struct(*columns), order).alias("_row")
    return df.groupBy(*by).agg(packed).select(*by, *[F.col(f"_row.{c}").alias(c) for c in columns if c not in by])


def top_rows(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key. Spark limits each task's rows to k for a key before it shuffles them."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")
