"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on passages of ordinary rows, one on the passages that set toxic rows apart
(runs of words that hold letter groups which toxic rows have far more often). Both compressors share the ordinary
dictionary's content, and the toxic one's adds its own, so on ordinary words the two agree. Dictionaries trained on all
words of their class do not find toxic rows that differ by a few words only; README gives the figures. A text is cut into
windows twice, the second time half a window later, so that what one cut parts is whole in the other. Each window's margin
is the bytes that the toxic dictionary saves. The largest margins, their mean, and how many reach certain sizes feed a
logistic threshold, calibrated on rows that the dictionaries were not trained on.

What is sampled, for fitting only: TOXIC_ROWS and ORDINARY_ROWS labelled rows; of a training row longer than
TRAIN_CHARS characters a stretch of that length; every k-th of more than TRAIN_WINDOWS ordinary windows. Of a trained
dictionary its content is used, without the entropy tables at its head. Calibration and scores read whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, stored

#: Bytes of a window, of letter groups, of the two dictionaries; the compressors' level.
WINDOW, GROUP, ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 64, 5, 110_000, 2_048, 3
#: Labelled rows used at most: toxic, ordinary. Half train the dictionaries, half calibrate.
TOXIC_ROWS, ORDINARY_ROWS = 1600, 4800
#: Characters of a training row, and ordinary windows, that reach the driver and the trainer at most.
TRAIN_CHARS, TRAIN_WINDOWS = 32_768, 20_000
#: Margins in bytes whose windows are counted; where the two cuts begin, in characters; features of both.
MARGINS, CUTS = (2, 3, 4, 5, 6, 8), (0, WINDOW // 2)
FEATURES = len(CUTS) * (len(MARGINS) + 6)


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of about `size` bytes of the lower-case text, cut at spaces (within twice the size)."""
    data = text.lower().encode()
    out, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + size, at + 2 * size)
        if end < 0:
            end = min(len(data), at + 2 * size) if len(data) - at > size else len(data)
        out.append(data[at:end])
        at = end + (data[end : end + 1] == b" ")
    return out


def groups(word: bytes) -> set[bytes]:
    return {word[i : i + GROUP] for i in range(max(1, len(word) - GROUP + 1))}


def telling_groups(toxic: list[str], ordinary: list[str], most: int = 256) -> set[bytes]:
    """Letter groups with the largest two-sample statistic of their share of rows, of those ten times as frequent in toxic rows."""
    counts: list[Counter] = []
    for texts in (toxic, ordinary):
        count: Counter = Counter()
        for text in texts:
            count.update({g for w in set(text.lower().encode().split()) for g in groups(w)})
        counts.append(count)
    a, b, n, m = *counts, len(toxic), len(ordinary)

    def rise(g: bytes) -> float:
        p = (a[g] + b[g]) / (n + m)
        return (a[g] / n - b[g] / m) / (p * (1 - p) * (1 / n + 1 / m)) ** 0.5 if 0 < p < 1 else 0.0

    found = {g: rise(g) for g in a if a[g] > 1 and a[g] / n >= 10 * (b[g] + 0.5) / m}
    top = max(found.values(), default=0.0)
    return {g for g in sorted(found, key=lambda g: (-found[g], g))[:most] if found[g] >= max(3.0, top / 4)}


def trained_content(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary trained on the samples, or the samples' end where there are too few to train on."""
    try:
        made = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]
    return made[len(made) // 4 :]  # without the entropy tables at its head


@dataclass
class Model:
    """Dictionary contents, and the logistic threshold: mean, scale and weight of each feature, and the bias."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        kind = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        contents = (model.ordinary, model.ordinary + model.toxic)
        self.plain, self.toxic = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **kind).compress if c else None for c in contents)

    def features(self, text: str) -> list[float]:
        out: list[float] = []
        plain, toxic = self.plain, self.toxic
        for start in CUTS:
            cut = windows(text[start:]) if plain else []
            if not cut:
                out += [0.0] * (FEATURES // len(CUTS))
                continue
            margins = [len(plain(w)) - len(toxic(w)) for w in cut]
            good = sorted([m for m in margins if m > 0], reverse=True)
            n = len(margins)
            out += [*map(float, [*good[:3], 0, 0, 0][:3]), sum(margins) / n, sum(m for m in good if m >= 3) / n**0.5]
            out += [math.log1p(sum(m >= k for m in good)) for k in MARGINS] + [math.log1p(n)]
        return out

    def scores(self, texts: list[str]) -> list[float]:
        m = self.model
        x = (np.array([self.features(t) for t in texts]).reshape(-1, FEATURES) - m.mean) / m.scale
        return (1 / (1 + np.exp(-np.clip(x @ m.weight + m.bias, -30, 30)))).tolist()


def trained(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries of training texts; nothing is calibrated yet."""
    none = np.zeros(FEATURES)
    if not toxic or not ordinary:
        return Model(b"", b"", none, none + 1, none, 0.0)
    telling = telling_groups(toxic, ordinary)
    apart = [w for t in toxic for w in t.lower().encode().split() if groups(w) & telling]
    passages = [b" ".join(apart[i : i + 6]) for i in range(0, len(apart), 6)]
    base = [w for t in ordinary for w in windows(t, 2 * WINDOW)]
    base = base[:: len(base) // TRAIN_WINDOWS + 1]
    return Model(trained_content(base, ORDINARY_BYTES), trained_content(passages, TOXIC_BYTES), none, none + 1, none, 0.0)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Fit the logistic threshold to features [rows, FEATURES] and labels; with one label only, its smoothed share."""
    if not model.ordinary or not (0 < y.sum() < len(y)):
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        model.bias = float(np.log(share / (1 - share)))
        return
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    w = np.zeros(FEATURES + 1)
    ridge = np.diag([1.0] * FEATURES + [1e-3])
    for _ in range(40):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - ridge @ w
        curve = (z * (p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, np.abs(step).max() / 2)
    model.weight, model.bias = w[:-1], float(w[-1])


def learned(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """A model of at most toxic_rows and ordinary_rows labelled documents, chosen by a hash of the id; every second one
    trains the dictionaries, the others calibrate.

    Only the chosen ids are broadcast, only TRAIN_CHARS characters of a training text and the features of a calibrating
    one reach the driver. Rows without label, id or text are not used. An id with several labels is toxic if any says so;
    one with several texts counts once, with the least. With no labels of either kind every score is the smoothed share of
    toxic rows; empty tables give such a model, too.
    """
    known = labels.select(F.col(id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    order = F.xxhash64("i")
    chosen = known.where("y = 1").orderBy(order, "i").limit(toxic_rows).unionByName(known.where("y = 0").orderBy(order, "i").limit(ordinary_rows))
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "i")
    rows = rows.groupBy("i", "y").agg(F.min("t").alias("t")).withColumn("h", order)
    rows = stored(rows.withColumn("turn", F.row_number().over(Window.partitionBy("y").orderBy("h", "i")) % 2))  # of bounded tables
    begin = F.pmod(F.col("h"), F.greatest(F.length("t") - TRAIN_CHARS, F.lit(0)) + 1)
    train = rows.where("turn = 1").select("y", "h", "i", F.col("t").substr((begin + 1).cast("int"), F.lit(TRAIN_CHARS)).alias("t")).collect()
    train.sort(key=lambda r: (r.h, r.i))
    model = trained([r.t for r in train if r.y == 1], [r.t for r in train if r.y == 0])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = sent.value.scorer()
        return lambda texts: [[scorer.features(t) for t in texts]]

    features = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    rest = map_texts(rows.where("turn = 0").select("y", "h", "i", "t"), "t", start, features, keep_text=False).collect() if model.ordinary else train
    rest.sort(key=lambda r: (r.h, r.i))
    calibrate(model, np.array([r.x for r in rest] if model.ordinary else np.zeros((len(rest), FEATURES))).reshape(-1, FEATURES), np.array([float(r.y) for r in rest]))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with a score between 0 and 1 for every whole text, higher the likelier it is toxic.

    Null and empty texts have no window and get the score of a text without any margin. Only the text is looked at, so
    equal texts have equal scores and repeated rows stay; an empty table gives an empty one. Extra columns stay, one named like the result is replaced. Rows are independent: no shuffle; a text costs two
    compressions of each window of both cuts, however long it is.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = sent.value.scorer()
        return lambda texts: [scorer.scores(texts)]

    return map_texts(docs, text, start, T.StructType([T.StructField(score, T.DoubleType())]), keep_text)


def held_out(id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id).cast("string")) % 5 == 0
