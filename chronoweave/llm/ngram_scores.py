"""Stupid-backoff language-model scores, computed relationally.

The corpus is packed into slices of documents where it is read. Each slice explodes its documents into n-grams of every
order up to `order` and sends each distinct one once, with its count there, to the part of the count table that its hash
falls in. A part adds the counts of all slices and answers each slice with the totals of the n-grams it asked for; the
slice joins them to its documents' n-grams again and sums the logarithms per document. N-grams travel as sorted columns of
64-bit hashes, thousands to a row (one n-gram to a row would shuffle over ten times the corpus), and totals come back in
the same order. Texts are shuffled once, compressed; both uses of the slices read the same exchange. Two n-grams with one
hash would share a count: of 10**9 distinct ones less than one in 10**10 does.

A document is scored with the counts of all other documents: its own occurrences are subtracted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trim, whole

#: Factor of each step back; bytes of text in a slice, and for each part of the count table. Both bound what a worker
#: holds, so their numbers grow with the corpus; a slice sends a row to a part only if it has n-grams there.
ALPHA, SLICE_BYTES, PART_BYTES = 0.4, 6 << 20, 8 << 20
ORDER = 3
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Keys of the numbers of words and of documents, counted like n-grams.
WORDS, DOCUMENTS = 1, 2
REMEMBERED_WORDS = 150_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_HASHES = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def exploded(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document of each word, for each order the key of the n-gram that ends at the word). Words are what stands between
    blanks; n-grams that reach before a document's begin are filled with a begin sign."""
    words = [t.encode().split() for t in texts]
    known = _HASHES
    h = np.array([known[w] for ws in words for w in ws], np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    del words
    begins = np.ones(len(h), bool)
    begins[1:] = owner[1:] != owner[:-1]
    keys = [_mixed(h + MIX)]
    for n in range(2, order + 1):
        before = np.roll(keys[-1], 1)
        before[begins] = np.uint64(n)
        keys.append(_mixed(before * MIX + h + np.uint64(n)))
    return owner, keys


def slice_counts(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of a slice with their counts; the numbers of words and documents are among them."""
    owner, keys = exploded(texts, order)
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    head = np.searchsorted(found, np.array([WORDS, DOCUMENTS], np.uint64))
    return np.insert(found, head, np.array([WORDS, DOCUMENTS], np.uint64)), np.insert(counts, head, [len(owner), len(texts)])


def own_counts(owner: np.ndarray, place: np.ndarray, distinct: int) -> np.ndarray:
    """How often each word's n-gram occurs in its own document. Most occur once, so only repeated ones are looked up."""
    pair = owner * distinct + place
    ordered = np.sort(pair)
    repeated, extra = np.unique(ordered[1:][ordered[1:] == ordered[:-1]], return_counts=True)
    out = np.ones(len(pair), np.int64)
    if len(repeated):
        at = np.minimum(np.searchsorted(repeated, pair), len(repeated) - 1)
        out += np.where(repeated[at] == pair, extra[at], 0)
    return out


def bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range of the hash begins and ends in ascending keys."""
    starts = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])


def packed(values: np.ndarray) -> bytes:
    """Byte planes, compressed: those that are all zero cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def pack_texts(texts: list[str]) -> tuple[list[int], bytes]:
    """Their bytes' lengths, and their bytes, compressed."""
    data = [t.encode() for t in texts]
    return [len(x) for x in data], zstandard.ZstdCompressor(level=9).compress(b"".join(data))


def unpack_texts(lengths: list[int], data: bytes) -> list[str]:
    whole_, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum([0, *lengths]).tolist()
    return [whole_[a:b].decode() for a, b in zip(ends, ends[1:])]


def pack_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def document_scores(texts: list[str], order: int, alpha: float, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, sum of logarithms, words found at the highest order) of each document, given the totals of the slice's
    ascending keys."""
    owner, keys = exploded(texts, order)
    n_words = np.bincount(owner, minlength=len(texts))
    if not len(owner):
        return n_words, np.zeros(len(texts)), n_words
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.concatenate(answers).astype(np.int64)
    head = np.searchsorted(found, np.array([WORDS, DOCUMENTS], np.uint64)) + np.arange(2)
    all_words, all_docs = totals[head].tolist()
    totals = np.delete(totals, head)
    begins = np.ones(len(owner), bool)
    begins[1:] = owner[1:] != owner[:-1]
    others = []  # totals without the document's own occurrences
    del keys
    for place in np.split(inverse, order):
        others.append(totals[place] - own_counts(owner, place, len(found)))
    rest = (all_words - n_words)[owner]
    score = np.where(others[0] > 0, np.log(np.maximum(others[0], 1)) - np.log(np.maximum(rest, 1)), np.log(alpha) - np.log(rest + 1))
    for n in range(2, order + 1):
        prefix = np.roll(others[n - 2], 1)
        prefix[begins] = all_docs - 1
        seen = others[n - 1] > 0
        score = np.where(seen, np.log(np.maximum(others[n - 1], 1)) - np.log(np.maximum(prefix, 1)), np.log(alpha) + score)
    top = others[-1] > 0
    return n_words, np.bincount(owner, score, len(texts)), np.bincount(owner, top, len(texts)).astype(np.int64)


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(id, n_words, n_seen, log_score): the stupid-backoff score of every whole text with the counts of all others.

    S(w | context) is count(context w) / count(context) if the n-gram occurs in another document, else alpha times S with
    a context shorter by a word; without context count(w) / words; for a word that no other document has, alpha / (words
    + 1). log_score sums the natural logarithms; n_seen counts words whose longest n-gram occurs elsewhere. Null and empty
    texts have no words and the score 0 (a document all the same). Repeated rows score each other. An empty table gives
    an empty one; other columns are not looked at, whatever their names. A very common n-gram is one number from each
    slice, and equal rows lie in the slices of where they are read, so neither makes a task heavier. A text longer than a
    slice is a slice. docs should be a table or a filter of one: slices follow the order in which rows are read, which a
    repeated task must find unchanged.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    rows = docs.select(F.col(id).alias("id"), whole(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def made() -> pa.RecordBatch:
            lengths, data = pack_texts(texts)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["slice", "ids", "lengths", "data"])

        for part, some in slices(batches, "text", SLICE_BYTES // 4):
            id_type = part.column(0).type
            for i, t in zip(part.column(0).to_pylist(), some, strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t)
            if held >= SLICE_BYTES:
                yield made()
                number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield made()

    sliced = rows.mapInArrow(pack, f"slice long, ids array<{kind}>, lengths array<long>, data binary").repartition(parts, "slice")

    def texts_of(pdf: pd.DataFrame) -> list[str]:
        return [t for n, x in zip(pdf["lengths"], pdf["data"], strict=True) for t in unpack_texts(list(n), x)]

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = slice_counts(texts_of(pdf), order)
        at = bounds(keys, parts)
        full = [p for p in range(parts) if at[p] < at[p + 1]]
        trim()
        return pd.DataFrame({"part": full, "slice": int(key[0]), "keys": [pack_keys(keys[at[p] : at[p + 1]]) for p in full], "counts": [packed(counts[at[p] : at[p + 1]].astype(np.uint64)) for p in full]})

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts_of = [unpack_keys(x) for x in pdf["keys"]]
        ends = np.cumsum([len(k) for k in parts_of])[:-1]
        keys = np.concatenate(parts_of)
        del parts_of
        place = np.argsort(keys)
        keys = keys[place]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        del keys
        counts = np.concatenate([unpacked(x, np.uint64) for x in pdf["counts"]])[place]
        totals = np.empty_like(counts)
        totals[place] = np.repeat(np.add.reduceat(counts, first), np.diff(first, append=len(counts)))
        del counts, place
        out = pd.DataFrame({"slice": pdf["slice"], "part": pdf["part"], "totals": [packed(x) for x in np.split(totals, ends)]})
        trim()
        return out

    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        totals = [unpacked(x, np.uint64) for x in answers.sort_values("part")["totals"]]
        n, logs, seen = document_scores(texts_of(docs), order, alpha, totals)
        trim()
        return pd.DataFrame({"id": [i for ids in docs["ids"] for i in ids], "n_words": n, "n_seen": seen, "log_score": logs})

    asked = sliced.groupBy("slice").applyInPandas(ask, "part int, slice long, keys binary, counts binary")
    answered = asked.groupBy("part").applyInPandas(answer, "slice long, part int, totals binary")
    out = sliced.groupBy("slice").cogroup(answered.groupBy("slice")).applyInPandas(score, f"id {kind}, n_words long, n_seen long, log_score double")
    return out.withColumnRenamed("id", id)


#: The same in DuckDB's SQL, for order 3, rounded like the query.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS cur, unnest(list_concat([''], w[:-2])) AS p1, unnest(list_concat(['', ''], w[:-3])[:len(w)]) AS p2 FROM d WHERE len(w) > 0),
size AS (SELECT r, len(w) AS n FROM d),
allw AS (SELECT sum(n) AS words, count(*) AS docs FROM size),
uni_own AS (SELECT r, cur AS word, count(*) AS c FROM t GROUP BY 1, 2),
uni AS (SELECT word, sum(c) AS c FROM uni_own GROUP BY 1),
bi_own AS (SELECT r, p1, cur, count(*) AS c FROM t GROUP BY 1, 2, 3),
bi AS (SELECT p1, cur, sum(c) AS c FROM bi_own GROUP BY 1, 2),
tri_own AS (SELECT r, p2, p1, cur, count(*) AS c FROM t GROUP BY 1, 2, 3, 4),
tri AS (SELECT p2, p1, cur, sum(c) AS c FROM tri_own GROUP BY 1, 2, 3),
x AS (
  SELECT t.r, tr.c - tro.c AS c3, b.c - bo.c AS c2, u.c - uo.c AS c1,
    CASE WHEN t.p1 = '' THEN a.docs - 1 ELSE q.c - qo.c END AS ctx2,
    CASE WHEN t.p1 = '' THEN a.docs - 1 ELSE p.c - po.c END AS ctx1, a.words - s.n AS rest
  FROM t JOIN tri tr USING (p2, p1, cur) JOIN tri_own tro ON tro.r = t.r AND tro.p2 = t.p2 AND tro.p1 = t.p1 AND tro.cur = t.cur
  JOIN bi b ON b.p1 = t.p1 AND b.cur = t.cur JOIN bi_own bo ON bo.r = t.r AND bo.p1 = t.p1 AND bo.cur = t.cur
  JOIN uni u ON u.word = t.cur JOIN uni_own uo ON uo.r = t.r AND uo.word = t.cur
  LEFT JOIN bi q ON q.p1 = t.p2 AND q.cur = t.p1 LEFT JOIN bi_own qo ON qo.r = t.r AND qo.p1 = t.p2 AND qo.cur = t.p1
  LEFT JOIN uni p ON p.word = t.p1 LEFT JOIN uni_own po ON po.r = t.r AND po.word = t.p1
  JOIN size s ON s.r = t.r, allw a),
y AS (
  SELECT r, count(*) FILTER (WHERE c3 > 0) AS n_seen,
    sum(CASE WHEN c3 > 0 THEN ln(c3) - ln(greatest(ctx2, 1)) WHEN c2 > 0 THEN ln(0.4) + ln(c2) - ln(greatest(ctx1, 1))
      WHEN c1 > 0 THEN 2 * ln(0.4) + ln(c1) - ln(greatest(rest, 1)) ELSE 3 * ln(0.4) - ln(rest + 1) END) AS s
  FROM x GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_seen, 0) AS BIGINT) AS n_seen, round(coalesce(s, 0), 4) AS log_score,
  round(coalesce(s, 0) / greatest(len(w), 1), 6) AS per_word
FROM d LEFT JOIN y USING (r)
"""
