"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns. The field then labels every token that holds a digit or an at sign; tokens end at
blanks and at brackets, quotes and the like. Neighbouring tokens share a chain potential; equal or similar tokens of a
document, however far apart, share a skip potential. Tokens of base spans are observed; loopy message passing carries
their labels along all edges, so a number that is personal in one place is found where it is repeated without the form
that the patterns need.

The field is trained on a bounded sample of texts. What it must learn is to find personal data that the patterns miss, so
base spans are hidden there at random, and repeats in other forms (without the plus sign, with other separators) are
planted beside strange numbers of the same forms. Tokens that are like an observed one have no label in training: they
may be such repeats themselves. Unary weights and potentials follow the gradient of the hidden labels' likelihood, with
expectations by message passing; the least sure marginal to act on is calibrated on texts set apart.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, whole

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
Span = tuple[int, int, str]
#: Rounds of message passing before the graph's extent is looked at.
SETTLING = 100

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match of these begins inside a run of digits, so looking behind changes nothing but keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What parts tokens, beside blanks. Tokens with a digit or an at sign are scanned in linear time, whatever their length.
CUTS = r"\x20\x09-\x0D,;:\"'`<>()\[\]{}|=!?#$&*/\\~^"
TOKEN = re.compile(rf"(?<![^{CUTS}])[^0-9@{CUTS}]*+[0-9@][^{CUTS}]*+")
CORE = re.compile(r"\+?[^\W_](?:.*[^\W_])?", re.S)
#: Kinds of edges: neighbours; equal tokens with many digits or an at sign; equal ones of 4 to 6 digits; similar ones.
CHAIN, EQUAL, SHORT, SIMILAR = range(4)
#: Weights are kept by hash of the feature; texts and tokens of a text that the field is fitted on at most.
BUCKETS, SAMPLE, MOST_TOKENS = 1 << 14, 2000, 256
#: Characters between neighbours at most; shares of base spans hidden, repeated and imitated in training.
GAP, HIDDEN, REPEATED, STRANGE = 4, 0.2, 0.5, 0.5
#: Share of false ones among what the field adds, at most, on the texts set apart for calibration.
FALSE = 0.02


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def octets(text: str) -> bool:
    return all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in text.split(".")) and all(int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the four patterns, by start, then kind; code points, end exclusive."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # what an address holds before its at sign is the whole run of such characters
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if octets(m[0]):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> str:
    """Runs of digits with their length, runs of letters as one sign, other characters as they are."""
    return re.sub(r"[0-9]+|[^\W\d_]+", lambda m: f"<{len(m[0])}>" if "0" <= m[0][0] <= "9" else "a", token)


def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % BUCKETS


@dataclass
class Tokens:
    """Candidate tokens of one document: spans, observed label or -1, features by bucket, and edges (a, b, kind)."""

    spans: list[tuple[int, int]]
    labels: list[int]
    features: list[list[int]]
    edges: list[tuple[int, int, int]]

    def linked(self) -> set[int]:
        """Tokens that share a skip potential with an observed one."""
        near = [(a, b) for a, b, kind in self.edges if kind != CHAIN]
        return {y for a, b in near for x, y in ((a, b), (b, a)) if self.labels[x] >= 0}


def tokens_of(text: str, base: list[Span]) -> Tokens:
    """Tokens, with edges between neighbours of one line and from each token to the hub of those like it.

    Alike are equal digits (4 at least; also of neighbours together), equal addresses, and short tokens with equal digits
    beside equal neighbours; similar are the same last 7 or first 8 digits, and the same name before the at sign. The hub is the first one observed with the label
    that most of them are observed with, else the first one, so a repeat is one edge from what was observed however many
    lie between."""
    spans: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        core = CORE.search(m[0])
        if core:
            spans.append((m.start() + core.start(), m.start() + core.end()))
    words = [text[a:b] for a, b in spans]
    shapes, digits = [shape(w) for w in words], [digits_of(w) for w in words]
    labels, ends = [-1] * len(spans), [b for _, b in spans]
    for start, end, kind in base:
        i = bisect_right(ends, start)
        while i < len(spans) and spans[i][0] < end:
            if labels[i] < 0:
                labels[i] = LABELS.index(kind)
            i += 1
    near = [False] * (len(spans) + 1)  # whether a token and the one before it are neighbours
    for i in range(1, len(spans)):
        gap = spans[i][0] - spans[i - 1][1]
        near[i] = gap <= GAP and "\n" not in text[spans[i - 1][1] : spans[i][0]]
    run, row = [0] * len(spans), [""] * len(spans)  # digits of all neighbours in a row: how many, and which in short rows
    first = 0
    for i in range(1, len(spans) + 1):
        if not near[i]:
            run[first:i] = [sum(map(len, digits[first:i]))] * (i - first)
            if 1 < i - first <= 8:
                row[first:i] = ["".join(digits[first:i])] * (i - first)
            first = i
    features: list[list[int]] = []
    alike: dict[tuple, list[int]] = {}
    for i, ((a, b), word) in enumerate(zip(spans, words, strict=True)):
        d = digits[i]
        found = ["bias", f"shape {shapes[i]}", f"digits {min(len(d), 20)}", f"run {min(run[i], 20)}"]
        found.append(f"before {shapes[i - 1]}" if near[i] else "before word")
        found.append(f"after {shapes[i + 1]}" if near[i + 1] else "after word")
        if word[0] == "+" or a and text[a - 1] == "+":
            found.append("plus")
        if "@" in word:
            name, _, host = word.lower().partition("@")
            found.append(f"at {'.' in host}")
            alike.setdefault((EQUAL, word.lower()), []).append(i)
            if len(name) >= 3:
                alike.setdefault((SIMILAR, "name", name), []).append(i)
        else:
            if len(d) >= 4:
                alike.setdefault((EQUAL if len(d) >= 7 else SHORT, d), []).append(i)
            else:
                if near[i + 1] and len(d) + len(digits[i + 1]) >= 4:
                    alike.setdefault((EQUAL, "first", d, digits[i + 1]), []).append(i)
                if near[i] and len(d) + len(digits[i - 1]) >= 4:
                    alike.setdefault((EQUAL, "last", digits[i - 1], d), []).append(i)
            if len(row[i]) >= 7:
                alike.setdefault((EQUAL, row[i]), []).append(i)
            if len(d) >= 7:
                alike.setdefault((SIMILAR, "end", d[-7:]), []).append(i)
            if len(d) >= 9:
                alike.setdefault((SIMILAR, "begin", d[:8]), []).append(i)
        if 12 <= len(d) <= 19:
            found.append(f"luhn {luhn(d)}")
        if word.count(".") == 3 and len(d) + 3 == len(word) and ".." not in word:
            found.append(f"octets {all(word.split('.')) and octets(word)}")
        features.append([_bucket(f) for f in found])
    edges = {(i - 1, i): CHAIN for i in range(1, len(spans)) if near[i]}
    for key, members in sorted(alike.items(), key=lambda x: x[0][0]):  # the closest likeness of two tokens counts
        if len(members) > 1:
            seen = Counter([labels[i] for i in members if labels[i] >= 0])
            most = seen.most_common(1)[0][0] if seen else -1
            hub = next(i for i in members if labels[i] == most)
            for i in members:
                if i != hub:
                    edges.setdefault((min(hub, i), max(hub, i)), key[0])
    return Tokens(spans, labels, features, [(a, b, kind) for (a, b), kind in edges.items()])


def other_form(span: str, kind: str, luck: random.Random) -> str:
    """The same personal data in a form that the patterns do not find."""
    if kind == "email":
        name, _, host = span.partition("@")
        return f"{name}@{host.partition('.')[0]}"
    if kind == "phone":
        return luck.choice([span.lstrip("+"), digits_of(span), span.partition(" ")[2] or digits_of(span)[1:]])
    if kind == "card":
        d = digits_of(span)
        return luck.choice([".", "/", "_"]).join(d[i : i + 4] for i in range(0, len(d), 4)) if luck.random() < 0.5 else f"{d}{luck.randrange(10)}"
    return span.replace(".", luck.choice(["-", "_"])) if luck.random() < 0.5 else span.rpartition(".")[0]


def strange(form: str, luck: random.Random) -> str:
    """Another token of this form: other digits, and other letters before an at sign."""
    name, at, host = form.partition("@")
    return "".join([str(luck.randrange(10)) if "0" <= c <= "9" else luck.choice("abcdefghijklmnopqrstuvwxyz") if at and c.isalpha() else c for c in name]) + at + host


def lesson(text: str, seed: int = 7) -> tuple[Tokens, list[int]]:
    """What a text teaches: its tokens, with planted ones at its end, and each one's label (-1: observed, or not known)."""
    luck = random.Random(xxhash.xxh64_intdigest(text, seed))
    base = base_spans(text)
    planted: list[tuple[int, int, int]] = []
    hidden = [s for s in base if luck.random() < HIDDEN]
    for a, b, kind in base:
        if luck.random() < REPEATED:
            form = other_form(text[a:b], kind, luck)
            planted.append((len(text) + 1, len(text) + 1 + len(form), LABELS.index(kind)))
            text += "\n" + form
        if luck.random() < STRANGE:
            form = strange(other_form(text[a:b], kind, luck), luck)
            planted.append((len(text) + 1, len(text) + 1 + len(form), 0))
            text += "\n" + form
    tokens = tokens_of(text, [s for s in base if s not in hidden])
    near = tokens_of(text, base).linked()  # to what is hidden, too
    truth = [-1 if label >= 0 or i in near else 0 for i, label in enumerate(tokens.labels)]
    known = sorted(planted + [(a, b, LABELS.index(kind)) for a, b, kind in hidden])
    for i, (a, b) in enumerate(tokens.spans):
        at = bisect_right(known, (a, len(text) + 1, 0)) - 1
        if at >= 0 and b <= known[at][1] and tokens.labels[i] < 0:
            truth[i] = known[at][2]
    if len(tokens.spans) > MOST_TOKENS:  # a stretch of them, the begin by luck
        at = luck.randrange(len(tokens.spans) - MOST_TOKENS + 1)
        tokens = Tokens(tokens.spans[at : at + MOST_TOKENS], tokens.labels[at : at + MOST_TOKENS], tokens.features[at : at + MOST_TOKENS], [(a - at, b - at, k) for a, b, k in tokens.edges if at <= a and b < at + MOST_TOKENS])
        truth = truth[at : at + MOST_TOKENS]
    return tokens, truth


def reach(edges: np.ndarray) -> int:
    """The greatest distance from each component's first node to others; no two nodes are more than twice that apart."""
    peers: dict[int, list[int]] = {}
    for a, b in edges.tolist():
        peers.setdefault(a, []).append(b)
        peers.setdefault(b, []).append(a)
    known: set[int] = set()
    out = 0
    for start in peers:
        level, steps = [start] if start not in known else [], 0
        known.add(start)
        while level := list({b for a in level for b in peers[a] if b not in known}):
            known.update(level)
            steps += 1
        out = max(out, steps)
    return out


def _send(belief: np.ndarray, back: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Messages over edges with these potentials, from nodes with these beliefs, less what came back from there."""
    out = (belief - back)[:, :, None] + pairs
    top = out.max(axis=1, keepdims=True)
    new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
    return new - new.max(axis=1, keepdims=True)


def _shares(x: np.ndarray) -> np.ndarray:
    axes = tuple(range(1, x.ndim))
    p = np.exp(x - x.max(axis=axes, keepdims=True))
    return p / p.sum(axis=axes, keepdims=True)


def pass_messages(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, pairs: np.ndarray, rounds: int | None = None, damping: float = 0.3) -> np.ndarray:
    """Marginals [nodes, labels] by loopy sum-product in logarithms. pairs[kind] holds the symmetric log potential of an
    edge (a, b) of that kind. Exact on trees; ends when messages settle, after `rounds` at the latest, or else after
    enough rounds for a message to cross the graph twice. Only messages that can still move are computed again."""
    belief = unary
    if len(edges):
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        kind = np.concatenate([kinds, kinds])
        messages = np.zeros((len(source), unary.shape[1]))
        belief = unary.copy()
        active, done, most = np.arange(len(source)), 0, rounds
        while len(active):
            if most is None and done == SETTLING:
                most = SETTLING + 4 * reach(edges)
            if most is not None and done >= max(most, 1):
                break
            step = (1 - damping) * (_send(belief[source[active]], messages[back[active]], pairs[kind[active]]) - messages[active])
            messages[active] += step
            np.add.at(belief, target[active], step)
            moved = active[np.abs(step).max(axis=1) >= 1e-5]
            fresh = np.zeros(len(unary), bool)
            fresh[target[moved]] = True
            again = fresh[source]
            again[moved] = True
            active = np.flatnonzero(again)
            done += 1
    return _shares(belief)


def expectations(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, pairs: np.ndarray, messages: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of nodes and, by kind, summed marginals of edges, after some rounds that begin with these messages; and the
    messages, for the next time."""
    a, b = edges[:, 0], edges[:, 1]
    source, target, kind = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([kinds, kinds])
    back = np.roll(np.arange(len(source)), len(a))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        messages = 0.3 * messages + 0.7 * _send(belief[source], messages[back], pairs[kind])
    belief = unary.copy()
    np.add.at(belief, target, messages)
    both = _shares((belief[a] - messages[len(a) :])[:, :, None] + (belief[b] - messages[: len(a)])[:, None, :] + pairs[kinds]) if len(a) else np.zeros((0, *pairs.shape[1:]))
    sums = np.zeros_like(pairs)
    np.add.at(sums, kinds, both)
    return _shares(belief), (sums + sums.transpose(0, 2, 1)) / 2, messages


def clamped(unary: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Unary scores that leave known labels (not below 0) no choice."""
    out = unary.copy()
    known = np.flatnonzero(labels >= 0)
    out[known] -= 50.0
    out[known, labels[known]] += 100.0
    return out


@dataclass
class Field:
    """Weights [buckets, labels], the potentials of each kind of edge, and the least marginal to act on."""

    weights: np.ndarray
    pairs: np.ndarray
    surety: float = 0.95

    def unary(self, tokens: Tokens) -> np.ndarray:
        out = np.array([self.weights[f].sum(axis=0) for f in tokens.features]).reshape(-1, len(LABELS))
        return clamped(out, np.array(tokens.labels, np.int64))

    def marginals(self, found: list[Tokens]) -> list[np.ndarray]:
        """For each document its tokens' marginals."""
        sizes = np.cumsum([0, *(len(t.spans) for t in found)])
        edges = np.array([(a + s, b + s, k) for t, s in zip(found, sizes.tolist()) for a, b, k in t.edges], np.int64).reshape(-1, 3)
        unary = np.concatenate([np.zeros((0, len(LABELS))), *(self.unary(t) for t in found)])
        return np.split(pass_messages(unary, edges[:, :2], edges[:, 2], self.pairs), sizes[1:-1])

    def added(self, texts: list[str], base: list[list[Span]], surety: float | None = None) -> list[list[Span]]:
        """For each text the spans beyond the base: tokens whose label is sure enough, neighbours of one label joined."""
        found = {i: tokens_of(x, b) for i, (x, b) in enumerate(zip(texts, base, strict=True)) if holds_token(x)}
        found = {i: t for i, t in found.items() if -1 in t.labels}
        out: list[list[Span]] = [[] for _ in texts]
        for (i, t), p in zip(found.items(), self.marginals(list(found.values()))):
            chain = {(a, b) for a, b, kind in t.edges if kind == CHAIN}
            previous = -2
            for k in np.flatnonzero((p[:, 1:].max(axis=1) >= (self.surety if surety is None else surety)) & (np.array(t.labels) < 0)).tolist():
                kind = LABELS[1 + int(p[k, 1:].argmax())]
                a, b = t.spans[k]
                if previous == k - 1 and (k - 1, k) in chain and out[i] and out[i][-1][2] == kind and out[i][-1][1] == t.spans[k - 1][1]:
                    out[i][-1] = (out[i][-1][0], b, kind)
                else:
                    out[i].append((a, b, kind))
                previous = k
            out[i] = [(a - opens(texts[i], a, b), b, kind) for a, b, kind in out[i]]
        return out


def opens(text: str, start: int, end: int) -> bool:
    """Whether a bracket that closes in this span opens right before it."""
    at = text.find(")", start, end)
    return start > 0 and text[start - 1] == "(" and at >= 0 and text.find("(", start, at) < 0


def holds_token(text: str) -> bool:
    return re.search(r"[0-9@]", text) is not None


def fit(lessons: list[tuple[Tokens, list[int]]], steps: int = 60, rate: float = 1.0, decay: float = 1e-3) -> Field:
    """A field whose weights and potentials rise along the gradient of the likelihood of the known labels, given the
    observed ones; every fourth lesson calibrates. Without any observed label it never adds anything."""
    n = len(LABELS)
    field = Field(np.zeros((BUCKETS, n)), np.zeros((4, n, n)), 2.0)
    part = [x for i, x in enumerate(lessons) if i % 4 != 3 and x[0].spans]
    if not any(label > 0 for t, _ in part for label in t.labels):
        return field
    sizes = np.cumsum([0, *(len(t.spans) for t, _ in part)]).tolist()
    edges = np.array([(a + s, b + s, k) for (t, _), s in zip(part, sizes) for a, b, k in t.edges], np.int64).reshape(-1, 3)
    ends, kinds = edges[:, :2], edges[:, 2]
    labels = np.array([x for t, _ in part for x in t.labels], np.int64)
    truth = np.array([x for _, y in part for x in y], np.int64)
    count = [len(f) for t, _ in part for f in t.features]
    flat, owner = np.array([f for t, _ in part for x in t.features for f in x], np.int64), np.repeat(np.arange(len(count)), count)
    often = np.bincount(flat, minlength=BUCKETS)[:, None]
    met = np.bincount(kinds, minlength=4)[:, None, None]
    all_known = np.where(truth >= 0, truth, labels)
    taught = np.zeros((2 * len(edges), n))
    free = taught.copy()
    for _ in range(steps):
        score = np.zeros((len(labels), n))
        np.add.at(score, owner, field.weights[flat])
        p, meets, taught = expectations(clamped(score, all_known), ends, kinds, field.pairs, taught)
        q, would, free = expectations(clamped(score, labels), ends, kinds, field.pairs, free)
        slope = np.zeros_like(field.weights)
        np.add.at(slope, flat, (p - q)[owner])
        field.weights += rate * n * (slope / (often + 5.0) - decay * field.weights)
        field.pairs += rate * n * ((meets - would) * n / (met + 5.0) - decay * field.pairs)
    field.surety = calibrated(field, [x for i, x in enumerate(lessons) if i % 4 == 3 and x[0].spans])
    return field


def calibrated(field: Field, lessons: list[tuple[Tokens, list[int]]], false: float = FALSE) -> float:
    """The least marginal, 0.5 at least, from which on no larger share of the tokens that would be added is not personal."""
    rows = []
    for (t, y), p in zip(lessons, field.marginals([t for t, _ in lessons])):
        for label, m in zip(y, p):
            k = 1 + int(m[1:].argmax())
            if label >= 0 and m[k] >= 0.5:
                rows.append((float(m[k]), label != k))
    rows.sort(reverse=True)
    sure, wrong = 0.95, 0
    for i, (m, bad) in enumerate(rows, 1):
        wrong += bad
        if wrong <= false * i:
            sure = m
    return sure


def trained(docs: DataFrame, text: str, sample: int, seed: int) -> Field:
    """A field fitted on at most `sample` distinct texts that hold a digit or an at sign, chosen by a seeded hash of the
    text, and MOST_TOKENS tokens of each. The hashes alone give the cut, so only texts below it are moved; their tokens'
    features, numbers of bounded count, not they, reach the driver."""
    source = docs.select(whole(text).alias("t")).where(F.col("t").rlike("[0-9@]")).select("t", F.xxhash64(F.lit(seed), "t").alias("h"))
    cut = source.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = source.where(F.col("h") <= F.lit(cut).cast("long")).dropDuplicates(["h"])
    whole_numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("y", whole_numbers), T.StructField("t", whole_numbers), T.StructField("f", T.ArrayType(whole_numbers)), T.StructField("e", T.ArrayType(whole_numbers))])

    def start():
        def make(texts: list[str]) -> list[list]:
            found = [lesson(x, seed) for x in texts]
            return [[t.labels for t, _ in found], [y for _, y in found], [t.features for t, _ in found], [[list(e) for e in t.edges] for t, _ in found]]

        return make

    rows = map_texts(chosen.withColumnRenamed("t", "_words"), "_words", start, schema, keep_text=False).collect()
    return fit([(Tokens([(0, 0)] * len(r.y), list(r.y), [list(f) for f in r.f], [tuple(e) for e in r.e]), list(r.t)) for r in sorted(rows, key=lambda r: r.h)])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def personal_data(docs: DataFrame, text: str = "text", sample: int = SAMPLE, seed: int = 7, surety: float | None = None, base: str = "base", spans: str = "spans", redacted: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with their base spans, all spans (base ones and those the field adds), and on demand the text with all spans
    replaced by <EMAIL>, <IP>, <CARD> or <PHONE> (overlapping ones by the first's).

    Every whole text is searched, and tokens of any length; null texts count as empty (redacted: empty), empty ones have no
    spans. The field is fitted on `sample` texts at most, and acts on marginals of `surety` or more (default: calibrated).
    Without any base span in the sample it adds nothing. Equal texts have equal results, repeated rows stay, an empty
    table gives an empty one. Extra columns stay, those named like results are replaced. Rows are independent: no
    shuffle; long texts are scanned in linear time.
    """
    field = docs.sparkSession.sparkContext.broadcast(trained(docs, text, sample, seed))
    added = T.StructType([T.StructField(base, SPANS), T.StructField(spans, SPANS), *([T.StructField(redacted, T.StringType())] if redacted else [])])

    def start():
        def make(texts: list[str]) -> list[list]:
            first = [base_spans(x) for x in texts]
            more = field.value.added(texts, first, surety)
            every = [sorted([*b, *m], key=lambda s: (s[0], KINDS.index(s[2]))) for b, m in zip(first, more, strict=True)]
            out = [[[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in found] for found in (first, every)]
            return out + ([[redact(x, s) for x, s in zip(texts, every, strict=True)]] if redacted else [])

        return make

    return map_texts(docs, text, start, added, keep_text)


def redact(text: str, spans: list[Span]) -> str:
    out, free = [], 0
    for a, b, kind in spans:
        if a >= free:
            out += [text[free:a], f"<{kind.upper()}>"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans as text."""
    kinds = F.transform("base", lambda s: s["kind"])
    n = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
