"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a share of the words of the mix. Whole passes over a source are taken first; the rest of its target is
a budget that some of its documents must sum to. Documents are counted by exact length; a proportional part of every
length is taken, and a bounded-knapsack dynamic program over the remaining lengths fits what is left of the budget to
the word. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

#: Weights of the sources in order, repeating; the mix's share of all words; how often a source may repeat.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words that the dynamic program fits at first; bytes of reached sums that it holds at once.
WINDOW, LEVELS = 65_536, 64 << 20
#: Parts of the hash's range by which the documents of one length are counted, so that a hot length is spread.
BINS = 1024


Change = tuple[int, int]  # (length's index, documents)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, at most counts, so that their lengths sum to the budget, or as near as
    the lengths allow (of two sums equally near the lower). Lengths are distinct and positive.

    A proportional part of each length is kept and the program fits the rest. If that misses the budget by more than the
    lengths' common divisor explains, an eighth as much again is kept, at last nothing: that is exact for any lengths and
    budget. The program's work grows with the rest, its memory with the rest and the logarithm of the lengths' number.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    divisor = int(np.gcd.reduce(lengths)) if len(lengths) else 1
    least = min(budget % divisor, -budget % divisor)  # no sum is nearer
    best, miss, rest = np.zeros_like(counts), budget, max(WINDOW, 4 * int(lengths.max(initial=0)))
    while miss > least:
        take = _fit(lengths, counts, budget, rest)
        off = abs(budget - int((lengths * take).sum()))
        if off < miss or off == miss and int((lengths * take).sum()) <= budget:
            best, miss = take, off
        if rest >= budget:
            break
        rest *= 8
    return best


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, rest: int) -> np.ndarray:
    """Take documents in proportion (first in whole numbers, then by the largest parts) until about `rest` words of the
    budget are left, then fit these exactly."""
    total, kept = int((lengths * counts).sum()), max(0, budget - rest)
    take = np.array([int(n) * kept // total for n in counts.tolist()], np.int64)
    part = np.array([int(n) * kept % total for n in counts.tolist()], np.float64)
    left = budget - int((lengths * take).sum())
    for i in [*np.argsort(-part, kind="stable").tolist(), *np.argsort(-lengths, kind="stable").tolist()]:
        if left <= rest:
            break
        more = min(int(counts[i] - take[i]), (left - rest) // int(lengths[i]), 1 if part[i] else left)
        part[i] = 0
        take[i] += more
        left -= more * int(lengths[i])
    free = np.flatnonzero(take < counts)
    if left <= 0 or not len(free):
        return take
    top = 2 * left  # a sum above the rest can be nearer to it than one below
    changes: list[Change] = []
    for i in free[np.argsort(lengths[free], kind="stable")].tolist():
        room, step = min(int(counts[i] - take[i]), top // int(lengths[i])), 1
        while room > 0:  # 1, 2, 4 ... documents, then the rest
            step = min(step, room)
            changes.append((i, step))
            room -= step
            step *= 2
    sizes = [step * int(lengths[i]) for i, step in changes]
    reach, used = 1, 0
    while used < len(changes) and not reach >> left & 1:
        reach = _reached(reach, sizes[used : used + 1], top)
        used += 1
    low = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    high = left + (above & -above).bit_length() if above else None
    at = high if high is not None and high - left < left - low else low
    del reach, above
    for j in _chosen(sizes[:used], 1, at, top)[0]:
        i, step = changes[j]
        take[i] += step
    return take


def _reached(reach: int, sizes: list[int], top: int) -> int:
    """Sums up to `top` that are reached with these sizes, too, as the bits of a number."""
    mask = (1 << (top + 1)) - 1
    for size in sizes:
        reach |= reach << size & mask
    return reach


def _chosen(sizes: list[int], reach: int, at: int, top: int, first: int = 0) -> tuple[list[int], int]:
    """Which sizes make up the sum `at`, from sums reached before, and what of it those before must have made up.

    Few sizes are gone through backwards with the sums reached before each; many are halved, the second half first, so
    that memory holds a few of these numbers only."""
    if len(sizes) * (top >> 3) > LEVELS and len(sizes) > 1:
        half = len(sizes) // 2
        late, at = _chosen(sizes[half:], _reached(reach, sizes[:half], top), at, top, first + half)
        early, at = _chosen(sizes[:half], reach, at, top, first)
        return early + late, at
    levels = [reach]
    for size in sizes[:-1]:
        levels.append(_reached(levels[-1], [size], top))
    out = []
    for j in range(len(sizes) - 1, -1, -1):
        if not levels[j] >> at & 1:
            out.append(first + j)
            at -= sizes[j]
    return out[::-1], at


def _key(source: Column) -> Column:
    """A text that tells a null source from any other."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_source, source_size, target) of rows (_source, size): weights go round by code point, null last; what is above
    `most` times a source's size is shared again by weight among the others until none is above.

    That is a level: target = least(most * size, level * weight). Each round shares what full sources leave among the
    others; only sums and the number of full sources reach the driver. Sources are numbered in two levels,
    by ranges; one count for each range is broadcast.
    """
    by = sizes.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn("_last", (F.col("_source") == "0").cast("int"))
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = stored(by.repartitionByRange(parts, "_last", "_source").withColumn("_bin", F.spark_partition_id()))
    counts = by.groupBy("_bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("_bin", (F.sum("n").over(Window.orderBy("_bin")) - F.col("n")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_bin").orderBy("_last", "_source")) + F.col("_first") - 1
    by = by.join(F.broadcast(counts), "_bin").withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    by = stored(by.withColumn("cap", most * F.col("source_size").cast("double")))
    pool = float(by.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        is_full = F.col("cap") <= F.lit(level) * F.col("w") if full >= 0 else F.lit(False)
        facts = by.agg(F.count(F.when(is_full, 1)), F.sum(F.when(is_full, F.col("cap"))), F.sum(F.when(~is_full, F.col("w")))).first()
        if facts[0] == full:
            break
        full = facts[0]
        if not facts[2]:  # all are full
            level = float("inf")
            break
        level = (pool - (facts[1] or 0.0)) / facts[2]
    return by.select("_source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def sized(docs: DataFrame, source: str = "source", text: str = "text", id: str = "doc_id", seed: int = 1) -> DataFrame:
    """docs with _source, size, and _hash, which decides who is taken; a column of one of these names is replaced."""
    return docs.withColumns({"_hash": F.xxhash64(F.lit(seed), F.col(id), F.col(text)), "_source": _key(F.col(source)), "size": word_count(text)})


def plan(sizes: DataFrame, **how) -> DataFrame:
    """(_source, size, source_size, target, base, take) for every source and length: whole passes, and how many documents
    of this length come once more. The dynamic program runs once for each source, over its counts by length."""
    goal = targets(sizes, **how)
    counts = sizes.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = goal.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = counts.join(goal, "_source")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        budget = round(float(pdf["target"].iloc[0]) - int(pdf["base"].iloc[0]) * int(pdf["source_size"].iloc[0]))
        words = (pdf["size"] > 0).to_numpy()
        pdf["take"] = 0
        pdf.loc[words, "take"] = fit_budget(pdf["size"].to_numpy(np.int64)[words], pdf["n"].to_numpy(np.int64)[words], budget)
        return pdf

    return rows.groupBy("_source").applyInPandas(fit, "_source string, size long, n long, source_size long, target double, base long, take long").drop("n")


def copies(sizes: DataFrame, planned: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """docs (sized; default: sizes) with source_size, target and _copies, how often the mix holds the document.

    Documents of a source and length are ordered by their hash. Counts by parts of the hash's range give each part's
    first rank, so ranking within a part is enough: a hot length is spread over 1,024 tasks. docs are shuffled once.
    """
    part = F.shiftrightunsigned("_hash", 54)
    bins = sizes.groupBy("_source", "size", part.alias("_bin")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_source", "size").orderBy("_bin")) - F.col("n")
    bins = bins.withColumn("_before", before).join(planned, ["_source", "size"]).drop("n")
    docs = (sizes if docs is None else docs).withColumn("_bin", part)
    rank = F.row_number().over(Window.partitionBy("_source", "size", "_bin").orderBy("_hash"))
    once_more = F.col("_before") + F.col("_rank") <= F.col("take")
    return docs.withColumn("_rank", rank).join(bins, ["_source", "size", "_bin"]).withColumn("_copies", F.col("base") + once_more.cast("long")).drop("_bin", "_rank", "_before", "base", "take")


def mixture(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1, **how) -> DataFrame:
    """(id, size, source_size, target, taken): the words that the mix takes from each document, repeats counted.

    Null and empty texts have no words; a null source is a source of its own. Sources without words have the target 0. The
    result depends on the rows alone, so reruns agree; of equal rows any may be taken, and each row has its result. A very
    long text counts whole, and is taken where the budget holds it. Extra columns are not looked at, whatever their names.
    Empty tables give empty ones.
    """
    light = stored(sized(docs, source, text, id, seed).select(F.col(id).alias("_id"), "_source", "size", "_hash"))
    out = copies(light, stored(plan(light, **how)))
    return out.select(F.col("_id").alias(id), "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    names = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    at = {c: f"_c{names.index(c)}" for c in (id, source, text)}
    rows = sized(renamed, at[source], at[text], at[id], seed)
    light = stored(rows.select("_source", "size", "_hash"))
    out = copies(light, stored(plan(light, **how)), rows).where("_copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
