"""Approximate nearest neighbours by balanced posting lists.

Vectors are extended so that the largest inner product becomes the smallest distance. Lists of about equal size are
found by balanced bisection of a bounded sample. Every vector goes to the list of its nearest centroid and, if it lies
near a boundary, to those of other centroids not much farther off. A query finds the centroids around it by best-first
search on an in-memory neighbour graph, and visits the lists whose centroid is not farther than a ratio of the nearest
one's distance; the ratio is calibrated on the sample against brute force. Lists are searched in blocks, exactly; only
scores that can be among a query's k best, as the sample bounds them, leave a block.

Equal vectors are indexed once with their k + 1 least ids: no more can be among anyone's k nearest, since ties go to the
least id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors the index is fitted on at most; among them queries for calibration, and vectors to bound scores by.
SAMPLE, CALIBRATION, BOUNDING = 131_072, 256, 16_384
#: Distinct vectors of a list, lists at most, lists of a vector at most, how much farther these may be.
LIST_SIZE, MOST_LISTS, REPLICAS, CLOSURE = 200, 8192, 4, 1.08
#: Recall that the ratio is calibrated for, links of a centroid in the graph.
RECALL, LINKS = 0.985, 16
#: Postings and queries that one task holds at most, about.
BLOCK, QUERY_BLOCK = 40_000, 20_000


@dataclass
class Index:
    """Centroids [lists, dim + 1] of extended vectors, their graph, the largest norm, the pruning ratio, and vectors of the
    sample with their lists (padded with the number of lists) to bound scores by."""

    centroids: np.ndarray
    graph: np.ndarray
    longest: float
    ratio: float
    sample: np.ndarray
    homes: np.ndarray

    def bounds(self, x: np.ndarray, visits: list[list[int]], k: int) -> np.ndarray:
        """For each query a score that its k-th best neighbour in the visited lists reaches for certain: the k-th best of
        the sample's vectors there."""
        out = np.full(len(x), -np.inf)
        for i in range(0, len(x), 256):
            scores = x[i : i + 256] @ self.sample.T
            for j, s in enumerate(scores, i):
                there = np.zeros(len(self.centroids) + 1, bool)
                there[visits[j]] = True
                s = s[there[self.homes].any(axis=1)]
                if len(s) >= k:
                    out[j] = np.partition(s, len(s) - k)[len(s) - k]
        return out - 1e-9 * (1 + np.abs(out, where=np.isfinite(out), out=np.zeros(len(out))))  # sums may be rounded otherwise there

    def extended(self, x: np.ndarray) -> np.ndarray:
        norms = np.einsum("ij,ij->i", x, x)
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - norms, 0.0))[:, None]])

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """For each vector its lists, the nearest centroid's first."""
        out = []
        for part in np.array_split(self.extended(x), max(1, len(x) // 2048)):
            d = distances(part, self.centroids)
            m = min(REPLICAS, d.shape[1])
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
            reach = np.take_along_axis(d, near, 1)
            out += [row[keep] for row, keep in zip(near, reach <= reach[:, :1] * CLOSURE, strict=True)]
        return out

    def visit(self, q: np.ndarray, ratio: float, enough: np.ndarray, least: int) -> list[int]:
        """Lists for one query: best-first search on the graph until the next centroid is farther than the ratio allows
        and the lists found hold `least` postings (enough: postings of each list)."""
        point = np.append(q, 0.0)
        far = {0: float(np.linalg.norm(self.centroids[0] - point))}
        heap = [(far[0], 0)]
        best, held, out = far[0], 0, []
        slack = 1.0  # the walk to the nearest centroid comes before pruning
        while heap:
            d, c = heapq.heappop(heap)
            best = min(best, d)
            new = [n for n in self.graph[c].tolist() if n not in far]
            if new:
                for n, x in zip(new, np.sqrt(((self.centroids[new] - point) ** 2).sum(axis=1)).tolist(), strict=True):
                    far[n] = x
                    heapq.heappush(heap, (x, n))
                    best = min(best, x)
            out.append((d, c))
            if heap and heap[0][0] > best * ratio * slack:
                held = sum(int(enough[c]) for d, c in out if d <= best * ratio)
                if held >= least:
                    break
                slack *= 1.1
        out.sort()
        cut, held = [], 0
        for d, c in out:
            if d > best * ratio and held >= least:
                break
            cut.append(c)
            held += int(enough[c])
        return cut


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(d, 0.0))


def bisected(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of parts of equal size: halves along the line between two means, again and again."""
    parts, out = [(np.arange(len(x)), lists)], []
    while parts:
        rows, n = parts.pop()
        if n <= 1 or len(rows) < 2:
            out.append(x[rows].mean(axis=0))
            continue
        y = x[rows]
        two = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(6):
            side = distances(y, two).argmin(axis=1)
            if side.all() or not side.any():
                break
            two = np.stack([y[side == 0].mean(axis=0), y[side == 1].mean(axis=0)])
        along = np.argsort(y @ (two[1] - two[0]), kind="stable")
        at = len(rows) * (n // 2) // n
        parts += [(rows[along[:at]], n // 2), (rows[along[at:]], n - n // 2)]
    return np.array(out)


def linked(centroids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """A neighbour graph: each centroid's nearest ones, and two ring links that keep it connected."""
    n = len(centroids)
    ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1)
    if n <= 3:
        return ring
    m = min(links, n - 1)
    near = []
    for first in range(0, n, 1024):  # distances to all, for some at once
        d = distances(centroids[first : first + 1024], centroids)
        d[np.arange(len(d)), first + np.arange(len(d))] = np.inf
        near.append(np.argpartition(d, m - 1, axis=1)[:, :m])
    return np.hstack([np.concatenate(near), ring])


def fit(sample: np.ndarray, longest: float, lists: int, k: int, recall: float = RECALL, seed: int = 1) -> Index:
    """An index of the sample, its ratio calibrated so that this share of true neighbours lies in the visited lists.

    Neighbours within a sample are farther off than among all rows, so the recall over all rows is higher.
    """
    rng = np.random.default_rng(seed)
    index = Index(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 2), np.int64), longest, 1.0, sample[:BOUNDING], np.zeros((len(sample[:BOUNDING]), REPLICAS), np.int64))
    if not len(sample):
        return index
    index.centroids = bisected(index.extended(sample), min(lists, len(sample)), rng)
    index.graph = linked(index.centroids)
    chosen = rng.choice(len(sample), min(CALIBRATION, len(sample)), replace=False)
    homes = index.lists_of(sample)
    index.homes = np.array([[*h, *[len(index.centroids)] * (REPLICAS - len(h))] for h in homes[:BOUNDING]])
    queries = np.hstack([sample[chosen], np.zeros((len(chosen), 1))])
    d = distances(queries, index.centroids)
    d /= np.maximum(d.min(axis=1, keepdims=True), 1e-12)
    s = sample[chosen] @ sample.T
    s[np.arange(len(chosen)), chosen] = -np.inf
    m = min(k, len(sample) - 1)
    if m > 0:
        needed = [min(d[i, c] for c in homes[j]) for i in range(len(chosen)) for j in np.argpartition(-s[i], m - 1)[:m]]
        index.ratio = float(np.quantile(needed, recall))
    return index


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, list_size: int = LIST_SIZE) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every`, its k nearest found among the other rows
    by inner product in double precision, nearest first, ties to the least id.

    Null vectors, zero vectors, those with null or non-finite components, of another length than most, or without id take
    no part. Rows of one id are not each other's neighbours. With fewer than k candidates all are returned. Every vector
    is indexed; the index is fitted on `sample` of the distinct ones at most, by hash. At most MOST_LISTS list sizes and
    the sample reach the driver, the centroids, and a row for each list and group, are broadcast. Lists grow in number with
    the table up to MOST_LISTS; a query goes to the lists it visits and postings to their group, so both move once, but
    for groups visited by more than QUERY_BLOCK queries. Repeated rows count once; other columns are not looked at. An
    empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = length.d if length else 1
    rows = rows.where(F.size("v") == dim)
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = stored(ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("key", F.xxhash64("v")))
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    count, longest = facts.n, float(facts.m or 0.0) ** 0.5
    chosen = distinct.select("key", "v").orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toPandas()["v"]
    points = np.array(chosen.tolist(), np.float64).reshape(-1, dim)
    index = fit(points, longest, max(1, min(MOST_LISTS, count // list_size, len(points) // 16)), k)
    sent = spark.sparkContext.broadcast(index)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, dim)
            homes = sent.value.lists_of(x)
            take = pa.array(np.repeat(np.arange(len(x)), [len(h) for h in homes]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(homes).astype(np.int32)), *(batch.column(i).take(take) for i in range(3))], names=["list", "v", "ids", "key"])

    postings = stored(distinct.select("v", "ids", "key").mapInArrow(post, "list int, v array<double>, ids array<long>, key long"))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in postings.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    # Lists of about BLOCK postings together make a group; a longer list is parted by key into several groups.
    pieces = np.maximum(1, -(-sizes // BLOCK))
    group, first, room = 0, [], 0
    for n, p in zip(sizes.tolist(), pieces.tolist(), strict=True):
        if p > 1 or room + n > max(BLOCK // 8, min(BLOCK, int(sizes.sum()) // 24)):
            group, room = group + (room > 0), 0
        first.append(group)
        group, room = (group + p, 0) if p > 1 else (group, room + n)
    grid = spark.sparkContext.broadcast((sizes, pieces, np.array(first)))
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v")
    questions = stored(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, pieces, first = grid.value
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, dim)
            at, to, which = [], [], []
            visits = [sent.value.visit(q, sent.value.ratio, sizes, (k + 1) * REPLICAS) for q in x]
            for i, lists in enumerate(visits):
                by: dict[int, list[int]] = {}
                for c in lists:
                    for g in range(first[c], first[c] + pieces[c]):
                        by.setdefault(int(g), []).append(c)
                at += [i] * len(by)
                to += by.keys()
                which += by.values()
            take = pa.array(at, pa.int64())
            least = pa.array(sent.value.bounds(x, visits, k + 1)).take(take)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(which, pa.list_(pa.int32())), batch.column(0).take(take), batch.column(1).take(take), least], names=["group", "lists", "v", "q", "least"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but a walk and a bound for each
    visits = stored(questions.select("v", "q").repartition(parts).mapInArrow(ask, "group int, lists array<int>, v array<double>, q long, least double"))
    # A group that more queries visit than a task may hold has its postings once for each part of them; others once.
    blocks = visits.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / QUERY_BLOCK)).cast("int").alias("blocks"))
    blocks = F.broadcast(stored(blocks))
    lists = spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(first, pieces, strict=True))], "list int, first int, pieces int")
    visits = visits.join(blocks, "group").withColumn("part", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks")
    placed = postings.join(F.broadcast(lists), "list").withColumn("group", (F.col("first") + F.pmod(F.col("key"), F.col("pieces"))).cast("int")).drop("first", "pieces")
    placed = placed.join(blocks, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        q = np.array(left["v"].tolist(), np.float64)
        by_list = {c: np.array(i) for c, i in right.groupby("list").indices.items()}
        asking: dict[int, list[int]] = {}
        for i, lists in enumerate(left["lists"]):
            for c in lists:
                asking.setdefault(int(c), []).append(i)
        v, least = np.array(right["v"].tolist(), np.float64), left["least"].to_numpy()
        who, what, score = [], [], []
        for c, mine in by_list.items():
            wants = np.array(asking.get(int(c), []), np.int64)
            for some in np.array_split(wants, max(1, len(wants) // 512)):
                if not len(some):
                    continue
                s = q[some] @ v[mine].T
                m = min(k + 1, len(mine))
                top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(mine) else np.tile(np.arange(m), (len(some), 1))
                # ties at the edge of the top go by id, so all of them stay
                edge = np.maximum(np.take_along_axis(s, top, 1).min(axis=1), least[some])
                more, cell = np.nonzero(s >= edge[:, None])
                who.append(some[more])
                what.append(mine[cell])
                score.append(s[more, cell])
        if not who:
            return pd.DataFrame({"q": [], "id": [], "score": []})
        who, what, score = np.concatenate(who), np.concatenate(what), np.concatenate(score)
        ids = right["ids"].to_numpy()
        n = np.array([len(ids[j]) for j in what])
        out = pd.DataFrame({"q": np.repeat(left["q"].to_numpy()[who], n), "id": np.concatenate([ids[j] for j in what]), "score": np.repeat(score, n)})
        out = out.sort_values(["q", "score", "id"], ascending=[True, False, True]).drop_duplicates(["q", "id"])
        return out.groupby("q", sort=False).head(k + 1)

    found = visits.groupBy("group", "part").cogroup(placed.groupBy("group", "part")).applyInPandas(search, "q long, id long, score double")
    found = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1).drop("r")
    out = asked.join(questions, "v").select("query_id", "q").distinct().join(best, "q").where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")
