"""Near copies by likeness: documents whose sets of word shingles have a Jaccard similarity of at least a bound.

Candidates come from Golay keys first: SimHash fingerprints of the sets within 2 bits, as in simhash.py. That is a radius
which misses most pairs (similarity 0.8 is about 10 bits), so MinHash finds the others: 16 bands of 4 minima, of which a
pair of similarity 0.8 shares one with probability 0.9998. Every candidate is verified exactly on the two texts, and verified links are closed to components.

Buckets of a few sets are compared pair by pair. In larger ones all sets are first compared with centres, which joins
copies without pairs; sets that are still apart then meet in blocks, where signatures of a byte for each minimum tell which
pairs can be similar at all, and these are verified there. So no link is left out for the size of its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.components import components

from .common import map_texts, stored, trim, whole
from .simhash import BATCH_SHINGLES, shingle_hashes
from .simhash import links as golay_links

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 16, 4
#: Members of buckets up to this size are compared pair by pair; centres of larger ones; sets in a side of a block.
PAIRED, CENTRES, BLOCK, BLOCK_BYTES = 24, 4, 512, 8 << 20
#: Equal bytes of two signatures from which on a pair is verified: at similarity 0.8 fewer come once in 10,000 pairs.
LIKELY = 38
_RNG = np.random.default_rng(42)
MASKS = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct hashes of the text's shingles."""
    return np.unique(np.frombuffer(b"".join(shingle_hashes(text, width)), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 for two empty ones."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def signatures(texts: list[str], width: int = WIDTH) -> tuple[list[int], list[list[int]], list[bytes], list[int]]:
    """For each text the digest of its shingle set (0 if empty), the keys of its bands (none if empty), a byte of each of its
    minima, and the SimHash of the set."""
    prints: list[int] = []
    digests: list[int] = []
    bands: list[list[int]] = []
    bytes_: list[bytes] = []
    pending: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pending:
            flat = np.concatenate(pending)
            sizes = np.array([len(x) for x in pending])
            starts = np.cumsum(sizes) - sizes
            least = np.stack([np.minimum.reduceat((flat ^ m) * f, starts) for m, f in zip(MASKS, FACTORS, strict=True)], axis=1)
            bytes_.extend(row.tobytes() for row in (least & np.uint64(255)).astype(np.uint8))
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1)
            set_ = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[:, None]
            prints.extend(np.packbits(set_, axis=1).view(">i8").ravel().tolist())
            for row in least.reshape(len(pending), BANDS, ROWS):
                bands.append([xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(row)])
        pending.clear()
        held = 0

    for text in texts:
        found = shingle_set(text, width)
        if not len(found):
            flush()
            digests.append(0)
            bands.append([])
            bytes_.append(b"")
            prints.append(0)
            continue
        digests.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
        pending.append(found)
        held += len(found)
        if held >= BATCH_SHINGLES:
            flush()
    flush()
    return digests, bands, bytes_, prints


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Pairs (a, b) whose texts (fp, text) are similar enough, by their whole shingle sets."""
    full = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            known: dict[int, np.ndarray] = {}  # a centre's text comes with each of its pairs
            keep = []
            for i, x in enumerate(a.to_pylist()):
                if x not in known:
                    known = {x: shingle_set(batch.column(2)[i].as_py(), width)}
                keep.append(similarity(known[x], shingle_set(batch.column(3)[i].as_py(), width)) >= least)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame, least: float = LEAST, block: int = BLOCK, likely: int = LIKELY) -> DataFrame:
    """Links (a, b) that join all rows (key, fp, class, sig, shingles) of a key which are similar enough, where rows of a
    class are joined already.

    A key's rows are dealt by hash to parts of about `block` rows and BLOCK_BYTES bytes; each two parts meet in a task of
    their own. Pairs whose signatures agree in `likely` bytes are verified there on their whole sets, unless they are
    joined by then, so only as many links as rows leave a block, however many pairs are similar.
    """
    size = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).cast("int")
    rows = rows.join(rows.groupBy("key").agg(size.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("lo"), F.greatest("part", o).alias("hi")))
    rows = rows.withColumn("at", F.explode(meets)).select("key", "at.lo", "at.hi", "part", "fp", "class", "sig", "shingles")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        fp, part = pdf["fp"].to_numpy(), pdf["part"].to_numpy()
        _, group = np.unique(pdf["class"].to_numpy(), return_inverse=True)  # of each row; joined ones take one number
        left, right = (np.flatnonzero(part == pdf[c].iloc[0]) for c in ("lo", "hi"))
        out = []
        for i in left.tolist():
            agree = right[((sigs[right] == sigs[i]).sum(axis=1) >= likely)]
            for j in agree[group[agree] != group[i]].tolist():
                if group[j] != group[i] and similarity(sets[i], sets[j]) >= least:
                    out.append((min(fp[i], fp[j]), max(fp[i], fp[j])))
                    group[group == group[j]] = group[i]
        trim()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def similar(docs: DataFrame, id: str = "doc_id", text: str = "text", component: str = "component_id", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(id, component) for every document; component is the least id reachable over links of similarity >= least, its own
    included. Null, empty and blank texts, which have no words, are one group.

    Equal sets are merged first, so copies cost nothing. Each set is compared with those that Golay keys find, and with the
    least one of each of its buckets;
    then those that are not connected yet are compared pair by pair in buckets of up to PAIRED sets, in larger ones with
    CENTRES of each bucket, which differ from band to band, and at last in blocks. Texts move once, and once for each pair
    compared. Ids may repeat and may be null; each row has its result. Long texts count whole. Other columns are not looked
    at. An empty table gives an empty one.
    """
    names = T.StructType([T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()), T.StructField("print", T.LongType())])
    source = docs.select(F.col(id).alias("id"), whole(text).alias("text")).withColumn("h", F.xxhash64("text"))
    base = stored(map_texts(source, "text", lambda: lambda texts: list(signatures(texts, width)), names, keep_text=False))
    distinct = stored(base.groupBy("fp").agg(F.min("id").alias("least"), F.min("h").alias("h"), F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("print").alias("print")))
    rows = distinct.select(F.explode("keys").alias("key"), "fp")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("centre")).where("n > 1")
    rows = stored(rows.join(sizes, "key"))
    # fingerprints within 2 bits, each stood for by its least set; sets of one fingerprint are held against that
    prints = stored(distinct.where(F.size("keys") > 0).groupBy("print").agg(F.min("fp").alias("stands"), F.count(F.lit(1)).alias("n")))
    stands = lambda x: prints.select(F.col("print").alias(x), F.col("stands").alias(f"s{x}"))
    near = golay_links(prints.select("print"), "print").join(stands("a"), "a").join(stands("b"), "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    same = distinct.select("fp", "print").join(prints.where("n > 1"), "print").where("fp <> stands").select(F.col("stands").alias("a"), F.col("fp").alias("b"))
    golay = stored(near.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    asked = rows.select("fp").union(golay.select("a")).union(golay.select("b")).distinct().join(distinct.select("fp", "h"), "fp")
    texts = stored(source.select("h", "text").join(asked, "h").groupBy("fp").agg(F.first("text").alias("text")))
    first = stored(rows.where("fp <> centre").select(F.col("centre").alias("a"), F.col("fp").alias("b")).union(golay).distinct())
    links = stored(verified(first, texts, width, least))

    def apart(of: DataFrame) -> DataFrame:
        """Rows (key, fp, n, class) of buckets that hold sets not connected yet."""
        classes = components(links, "a", "b").withColumnRenamed("node", "fp")
        marked = of.select("key", "fp", "n").join(classes, "fp", "left").select("key", "fp", "n", F.coalesce("component", "fp").alias("class"))
        mixed = marked.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
        return stored(marked.join(mixed, "key"))

    side = lambda df, x: df.select("key", F.col("fp").alias(x), F.col("class").alias(f"c{x}"))
    open_rows = apart(rows)
    small = open_rows.where(F.col("n") <= PAIRED)
    pairs = side(small, "a").join(side(small, "b"), "key").where("ca <> cb and a < b").select("a", "b")
    large = open_rows.where(F.col("n") > PAIRED)
    order = F.struct(F.xxhash64("key", "fp", F.col("turn")).alias("o"), "fp", "class")
    turns = large.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(CENTRES)])))
    centres = turns.groupBy("key", "turn").agg(F.min(order).alias("m")).select("key", F.col("m.fp").alias("a"), F.col("m.class").alias("ca")).distinct()
    stars = centres.join(side(large, "b"), "key").where("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(pairs.unionByName(stars).distinct().join(first, ["a", "b"], "left_anti"))
    links = stored(links.unionByName(verified(more, texts, width, least)))

    if not large.isEmpty():
        open_rows = apart(large)
        if not open_rows.isEmpty():
            asked = open_rows.select("fp").distinct()
            whole_sets = T.StructType([T.StructField("shingles", T.BinaryType())])
            sets = stored(map_texts(texts.join(asked, "fp", "left_semi"), "text", lambda: lambda some: [[shingle_set(t, width).tobytes() for t in some]], whole_sets, keep_text=False))
            marked = open_rows.select("key", "fp", "class").join(distinct.select("fp", "sig"), "fp").join(sets, "fp")
            links = links.unionByName(stored(in_blocks(marked, least)))

    found = components(links, "a", "b")
    classes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    groups = classes.groupBy("class").agg(F.min("least").alias("component"))
    of_fp = classes.join(groups, "class").select("fp", "component")
    return base.join(of_fp, "fp").select(F.col("id").alias(id), F.col("component").alias(component))
