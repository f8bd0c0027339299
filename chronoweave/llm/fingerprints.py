"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Each paragraph is hashed to a wide vector; a fingerprint is the sum of its paragraphs' vectors, lane by lane modulo
2**32. Sums do not depend on order, so equal multisets of paragraphs have equal fingerprints, and inserting or deleting
a paragraph adds or subtracts its vector. The first lanes are uniform bits of a cryptographic hash and decide equality.
The others hold a signed count of the paragraph's word triples (each triple adds +1 or -1 to one lane); inner products
of these lanes estimate the triples that two documents share, which gives a likeness between 0 and 1.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, slices, trim

EQUAL_LANES, LIKE_LANES = 64, 256
LANES = EQUAL_LANES + LIKE_LANES
#: Odd multipliers that mix the three words of a triple.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
REMEMBERED_WORDS = 300_000


class _Words(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_WORDS = _Words()


def paragraphs(text: str) -> list[str]:
    """What stands between line feeds, without empty pieces."""
    return [x for x in text.split("\n") if x]


def vectors(groups: list[list[str]]) -> np.ndarray:
    """For each list of paragraphs the sum of their vectors: uint32 [groups, LANES]."""
    out = np.zeros((len(groups), LANES), np.uint32)
    flat = [p for g in groups for p in g]
    if not flat:
        return out
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    digests = b"".join([hashlib.shake_128(p.encode()).digest(4 * EQUAL_LANES) for p in flat])
    filled, first = np.unique(group, return_index=True)
    out[filled, :EQUAL_LANES] = np.add.reduceat(np.frombuffer(digests, "<u4").reshape(-1, EQUAL_LANES), first, axis=0, dtype=np.uint32)
    words = [p.split() for p in flat]
    n = [len(w) for w in words]
    word = _WORDS
    h = np.array([word[w] for ws in words for w in ws], np.uint64)
    if len(h):
        owner = np.repeat(np.arange(len(flat)), n)
        triple = h * np.uint64(MIX[0])
        for ahead in (1, 2):  # past a paragraph's end there is nothing to add
            same = owner[:-ahead] == owner[ahead:]
            triple[:-ahead][same] ^= h[ahead:][same] * np.uint64(MIX[ahead])
        triple ^= triple >> np.uint64(31)
        triple *= np.uint64(MIX[0])
        lane = (triple >> np.uint64(40)) % np.uint64(LIKE_LANES)
        sign = np.where(triple >> np.uint64(63), 1, -1)
        cell = np.repeat(group, n) * LIKE_LANES + lane.astype(np.int64)
        out[:, EQUAL_LANES:] = np.bincount(cell, sign, len(groups) * LIKE_LANES).astype(np.int64).astype(np.uint32).reshape(-1, LIKE_LANES)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: 1 for equal fingerprints, else the cosine of the signed counts, between 0 and 1."""
    equal = (a == b).all(axis=1)
    x, y = (v[:, EQUAL_LANES:].astype(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    near = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where(equal, 1.0, np.clip(near, 0.0, 1.0))


def to_text(vector: np.ndarray) -> str:
    return base64.b64encode(vector.astype("<u4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def insert(fingerprint: str, added: list[str]) -> str:
    """The fingerprint after these paragraphs were added."""
    return to_text(from_text(fingerprint) + vectors([added])[0])


def delete(fingerprint: str, removed: list[str]) -> str:
    """The fingerprint after these paragraphs, which it holds, were removed."""
    return to_text(from_text(fingerprint) - vectors([removed])[0])


def fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """docs with a fingerprint of every whole text. Null and empty texts have the zero vector, equal texts equal ones.
    Repeated rows stay; extra columns too, one named like the result is replaced; an empty table gives an empty one. No
    shuffle; long texts cost their length."""
    return map_texts(docs, text, lambda: lambda texts: [[to_text(v) for v in vectors([paragraphs(x) for x in texts])]], T.StructType([T.StructField(fingerprint, T.StringType())]), keep_text)


def numbers(values: list[int]) -> Column:
    """A constant array: one literal in the plan, however many numbers."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def block_of(key: Column, bounds: list[int]) -> Column:
    """Index of the last bound that is not above the key; bounds ascend, the first is not above any key. Native, two levels deep."""
    step = max(1, int(len(bounds) ** 0.5))
    tops, all_bounds = (numbers(x) for x in (bounds[::step], bounds))
    top = F.size(F.filter(tops, lambda b: b <= key)) - 1
    return top * step + F.size(F.filter(F.slice(all_bounds, top * step + 1, F.lit(step)), lambda b: b <= key)) - 1


def with_next(docs: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
    """Rows for workers that read documents in ascending order of key and need each one's successor: (_block, _ahead, key, text).

    Blocks are ranges of the key that begin at keys which occur (approximate quantiles, so as many numbers as blocks reach
    the driver). A block's first rows also go to the end of the block before (_ahead 1), the table's first to the end of
    the last. Null keys come first. Every text is shuffled once; within a block rows are sorted by key, then text.
    """
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("_key"), F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    found = rows.agg(F.min("_key"), F.percentile_approx("_key", [i / blocks for i in range(1, blocks)] or [0.5], max(10_000, 20 * blocks))).first()
    bounds = sorted({found[0], *found[1]}) if found[0] is not None else [low]
    own, first = block_of(F.col("_key"), bounds), F.element_at(numbers(bounds), (F.col("_block") + 1).cast("int")) == F.col("_key")
    before = F.when(F.col("_block") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("_block") - 1)
    rows = rows.withColumn("_block", own)
    at = F.when(first, F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("a")), F.struct(before.alias("b"), F.lit(1).alias("a")))).otherwise(F.array(F.struct(F.col("_block").alias("b"), F.lit(0).alias("a"))))
    rows = rows.withColumn("_at", F.explode(at)).select(F.col("_at.b").alias("_block"), F.col("_at.a").alias("_ahead"), "_key", key, text)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "_block").sortWithinPartitions("_block", "_ahead", "_key", text).drop("_key")


def edited_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document beside an edited copy: the last half of its characters replaced by the next document's first as many.

    The next document is the one that follows in ascending order of key (equal keys: by text, so repeated rows follow each
    other; null keys first; the first one after the last). Null texts count as empty. Long texts count whole; a worker
    holds two neighbours at once. Extra columns are not looked at, whatever their names. The edited fingerprint is updated from the document's: the paragraphs of its second half are
    deleted, the new ones inserted. Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. An empty table gives an empty one; a single document follows itself.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, key, text, 4 * parts)
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        kept: list[tuple] = []  # the last row, whose successor is yet to come, with its two vectors
        for part, texts in slices(batches, text):
            names = part.schema.names
            block, ahead, ids = (part.column(names.index(c)).to_pylist() for c in ("_block", "_ahead", key))
            cuts = []
            for x in texts:
                cut = len(x) - len(x) // 2
                cuts.append((cut, x.rfind("\n", 0, cut) + 1))
            halves = vectors([paragraphs(h) for x, (_, at) in zip(texts, cuts, strict=True) for h in (x[:at], x[at:])])
            rows = kept + [(block[i], ahead[i], ids[i], x, *cuts[i], halves[2 * i], halves[2 * i + 1]) for i, x in enumerate(texts)]
            kept = rows[-1:]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            if not pairs:
                continue
            fills = [b[3][: len(a[3]) // 2] for a, b in pairs]
            new = vectors([paragraphs(a[3][a[5] : a[4]] + f) for (a, _), f in zip(pairs, fills, strict=True)])
            head, tail = (np.stack([a[k] for a, _ in pairs]) for k in (6, 7))
            full = head + tail
            edited = full - tail + new
            following = np.stack([b[6] + b[7] for _, b in pairs])
            columns = [[a[2] for a, _ in pairs], [len(a[3]) for a, _ in pairs], [hashlib.sha256((a[3][: a[4]] + f).encode()).hexdigest() for (a, _), f in zip(pairs, fills, strict=True)], [to_text(v) for v in full], [to_text(v) for v in edited], likeness(full, edited), likeness(full, following)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
        trim()

    return rows.mapInArrow(run, schema)
