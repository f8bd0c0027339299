"""SimHash near-duplicates, linked through Golay-code fuzzy hashing.

A 64-bit fingerprint is parted into three segments. Two fingerprints that differ in 2 bits at most have some segment
without an error whose successor has one error at most (pigeonhole, around the circle of three). The binary Golay code
of 23 bits is perfect: every word has exactly one codeword within distance 3. So if two words differ in one bit, the
nearest codeword of one is within distance 4 of the other. A fingerprint's keys are, for each of the three positions,
an exact segment with the index of each codeword near the next segment (5.3 on average). Fingerprints that share a key
are candidates and verified; their links are closed to components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.components import components

from .common import map_texts, plain, stored

#: Generator polynomial of the binary Golay code, its length and parity bits.
GOLAY, LENGTH, PARITY = 0b110001110101, 23, 11
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
#: Buckets of more members than this are linked by flipped bits, not by pairs.
PAIRED = 24
BATCH_SHINGLES = 1 << 16


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> list[bytes]:
    """XXH64 digests of the text's shingles, repeats included, with A-Z in lower case."""
    words = text.encode().lower().split()  # of bytes: only ASCII letters and blanks count
    digest = xxhash.xxh64_digest
    if not words:
        return []
    if len(words) <= width:
        return [digest(b" ".join(words), seed)]
    return [digest(b" ".join(words[i : i + width]), seed) for i in range(len(words) - width + 1)]


def simhashes(texts: list[str]) -> list[int]:
    """The fingerprint of each text, as a signed 64-bit number: a bit is 1 if set in over half the shingles' hashes."""
    out: list[int] = []
    pending: list[list[bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        sizes = np.array([len(x) for x in pending])
        bits = np.unpackbits(np.frombuffer(b"".join([h for x in pending for h in x]), np.uint8).reshape(-1, 8), axis=1)
        counts = np.zeros((len(pending), 64), np.int64)
        if filled := np.flatnonzero(sizes).tolist():
            counts[filled] = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[filled], axis=0, dtype=np.int64)
        out.extend(np.packbits(2 * counts > sizes[:, None], axis=1).view(">i8").ravel().tolist())
        pending.clear()
        held = 0

    for text in texts:
        pending.append(shingle_hashes(text))
        held += len(pending[-1])
        if held >= BATCH_SHINGLES:
            flush()
    if pending:
        flush()
    return out


def fingerprinted(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """docs with the SimHash of every whole text as a long. Null, empty and blank texts have 0; a bit set in just half the
    hashes is 0. Repeated rows stay; extra columns too, one named like the result is replaced. Long texts count whole; their
    hashes are held for one text at a time. An empty table gives an empty one. No shuffle."""
    return map_texts(docs, text, lambda: lambda texts: [simhashes(texts)], T.StructType([T.StructField(fingerprint, T.LongType())]), keep_text)


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainder of each 23-bit position; for each of the 2,048 remainders the error patterns of weight 4 at most (up to
    six, the lightest first, padded with -1)."""
    remainder = []
    for i in range(LENGTH):
        r = 1 << i
        for top in range(LENGTH - 1, PARITY - 1, -1):
            if r >> top & 1:
                r ^= GOLAY << (top - PARITY)
        remainder.append(r)
    patterns: dict[int, list[int]] = {}
    for weight in range(5):
        for at in combinations(range(LENGTH), weight):
            r = 0
            for i in at:
                r ^= remainder[i]
            patterns.setdefault(r, []).append(sum(1 << i for i in at))
    most = max(map(len, patterns.values()))
    table = np.full((1 << PARITY, most), -1, np.int64)
    for r, found in patterns.items():
        table[r, : len(found)] = found
    return np.array(remainder, np.int64), table, np.array([len(patterns[r]) for r in range(1 << PARITY)])


def near_codewords(words: np.ndarray) -> np.ndarray:
    """For 23-bit words the indices of the codewords within distance 4, the nearest first, padded with -1."""
    remainder, table, _ = golay_tables()
    r = np.zeros(len(words), np.int64)
    for i in range(LENGTH):
        r ^= np.where(words >> i & 1, remainder[i], 0)
    errors = table[r]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> PARITY)


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row of the fingerprint, whether the key holds the nearest codeword) for signed 64-bit fingerprints."""
    bits = fingerprints.astype(np.int64).view(np.uint64)
    parts = [((bits >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64) for shift, n in SEGMENTS]
    keys, rows, own = [], [], []
    for k, exact in enumerate(parts):
        near = near_codewords(parts[(k + 1) % 3])
        row, place = np.nonzero(near >= 0)
        keys.append((k << 34) | (exact[row] << 12) | near[row, place])
        rows.append(row)
        own.append(place == 0)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(own)


def keyed(distinct: DataFrame, fingerprint: str) -> DataFrame:
    """(key, fp, own) of distinct fingerprints."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("own", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            key, row, own = golay_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(own)], names=["key", "fp", "own"])

    return distinct.select(F.col(fingerprint).cast("long")).mapInArrow(run, schema)


def links(distinct: DataFrame, fingerprint: str = "fingerprint", paired: int = PAIRED) -> DataFrame:
    """Links (a, b) whose closure joins all distinct fingerprints that differ in 2 bits at most.

    Candidates of a bucket with up to `paired` members are compared pair by pair. Members of larger buckets, where many
    fingerprints differ in few bits, are linked without pairs: two differ in 2 bits at most exactly if flipping one bit
    or none of each can give the same word, so each is linked to the least one that reaches one of its 65 words.
    """
    rows = keyed(distinct, fingerprint)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own")
    rows = stored(rows.join(sizes.select("key", "n"), "key"))
    small = rows.where(F.col("n") <= paired)
    one, two = small.where("own").select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = one.join(two, "key").where("a <> b and bit_count(a ^ b) <= 2").select("a", "b")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    large = rows.where(F.col("n") > paired).select("fp").distinct()
    flipped = large.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    centres = flipped.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = flipped.join(centres.select("word", "b"), "word").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", component: str = "component_id", fingerprint: str = "fingerprint") -> DataFrame:
    """(id, fingerprint, component) for every document; component is the least id reachable over links, its own included.

    Equal fingerprints are linked, zero ones too. Extra columns are not looked at, whatever their names. Ids may repeat: each row has its result. Null ids take part, but a
    component's id is null only if all its ids are. Empty tables give empty ones. Copies are merged before linking (with
    partial aggregation), so their number costs nothing; the last join is on the fingerprint and skewed by copies, which
    adaptive execution splits.
    """
    base = stored(fingerprinted(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "fp", False))
    distinct = base.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(distinct, "fp"), "a", "b")
    classes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    least = classes.groupBy("class").agg(F.min("least").alias("component"))
    of_fp = classes.join(least, "class").select("fp", "component")
    return base.join(of_fp, "fp").select(F.col("id").alias(id), F.col("fp").alias(fingerprint), F.col("component").alias(component))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", find: Callable[..., DataFrame] | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least id; of equal ids the least (fingerprint, text hash), of equal rows one.

    find(docs, id, text, component) gives the groups: near_duplicates, or another of its kind. Columns and their order stay, whatever their names. One join by row (id and text hash) moves each text once; it also
    brings equal rows together.
    """
    names = docs.columns
    mark = plain("_row", names)
    row = F.struct(F.col(f"`{id}`").alias("i"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    found = (find or near_duplicates)(docs.select(row.alias("i"), F.col(f"`{text}`").alias("t")), "i", "t", "c")
    # as text, which is never null, so that the join's partitioning also serves dropDuplicates
    name = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), h)
    kept = found.where("i <=> c").select(name(F.col("i.i"), F.col("i.h")).alias(mark)).distinct()
    marked = docs.withColumn(mark, name(F.col(f"`{id}`"), F.xxhash64(F.col(f"`{text}`"))))
    return marked.join(kept, mark, "left_semi").dropDuplicates([mark]).select(*[F.col(f"`{c}`") for c in names])
