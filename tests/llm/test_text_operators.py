"""BPE, token counts, fingerprints, toxicity and personal data against the libraries, brute force and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoweave.llm import bpe, common, fingerprints, pii, queries, token_counts, toxicity

from .conftest import ODD, SMALL

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
library = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
PIECES = [" ", "  ", "\n", "\t", "a", "th", "er", "'s", "'LL", "1", "23", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "é", "é", "日本", "ΑΣ", "İ", "\x1c", "\x85", "​", "𐐀", "ß"]
texts = st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=25).map("".join).filter(lambda s: not re.search("[\ud800-\udfff]", s))


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(open(WORD).read())


@settings(max_examples=300, deadline=None)
@given(text=texts)
def test_bpe_equals_library(encoder, text):
    ids = encoder.encode(text)
    assert ids == library[WORD].encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == library[WORD].decode(ids, skip_special_tokens=False)


def test_bpe_equals_plain_merging_on_token_strings(encoder):
    rng, names = random.Random(1), list(encoder.vocabulary.text.values())
    for _ in range(2000):
        word = "".join(rng.choice(names).replace("</w>", "") for _ in range(rng.randint(1, 3)))
        assert encoder.vocabulary.encode_word(word) == [library[WORD].token_to_id(t.value) for t in library[WORD].model.tokenize(word)]


def test_bpe_every_row(spark, odd):
    out = bpe.encode_documents(odd.withColumn("IDS", F.lit(1)), WORD)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.ids == library[WORD].encode(r.text or "", add_special_tokens=False).ids
    again = bpe.decode_documents(out, WORD, decoded="back")
    assert again.where("back <> decoded").count() == 0
    assert bpe.encode_documents(odd.limit(0), WORD).count() == 0


@settings(max_examples=150, deadline=None)
@given(text=texts, chunk=st.sampled_from([0, 48, 80]))
def test_token_counts_splice_exactly(text, chunk):
    counter = token_counts.Counter(open(BYTE).read(), chunk, 0)
    text = text * 4
    spans = list(counter.spans(text))
    assert sum(n for _, _, n in spans) == len(library[BYTE].encode(text, add_special_tokens=False))
    assert [s[0] for s in spans] == [0, *[s[1] for s in spans[:-1]]] and spans[-1][1] == len(text)


def test_token_counts_every_row(odd):
    rows = token_counts.token_counts(odd.withColumn("N_TOKENS", F.lit("clash")), BYTE, chunk=1000, overlap=64).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_tokens == len(library[BYTE].encode(r.text or "", add_special_tokens=False)) for r in rows)
    assert token_counts.token_counts(odd.limit(0), BYTE).count() == 0


def test_fingerprints_add_up():
    a, b, c = "one two three", "four five", "six"
    whole = fingerprints.to_text(fingerprints.vectors([[a, b, c]])[0])
    assert whole == fingerprints.to_text(fingerprints.vectors([[c, a, b]])[0])
    part = fingerprints.delete(whole, [b])
    assert part == fingerprints.to_text(fingerprints.vectors([[a, c]])[0]) != whole
    assert fingerprints.insert(part, [b]) == whole
    assert fingerprints.to_text(fingerprints.vectors([[a, a]])[0]) != fingerprints.to_text(fingerprints.vectors([[a]])[0])
    v = fingerprints.vectors([[a, b], [b, a], [], [c]])
    assert fingerprints.likeness(v[[0, 2, 2]], v[[1, 2, 3]]).tolist() == [1.0, 1.0, 0.0]


@pytest.mark.parametrize("parts", ["1", "3"])
def test_edited_texts_against_brute_force(spark, odd, parts):
    rows = [(i, t) for i, t in ODD if not (i == 5)] + [(5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {r.doc_id: r for r in fingerprints.edited_with_next(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    assert len(found) == len(order)
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        v = fingerprints.vectors([fingerprints.paragraphs(x) for x in (t, edited, n)])
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(map(fingerprints.to_text, v[:2]))
        assert r.near_edited == pytest.approx(fingerprints.likeness(v[:1], v[1:2])[0])
        assert r.near_next == pytest.approx(fingerprints.likeness(v[:1], v[2:])[0])
    assert fingerprints.edited_with_next(docs.limit(0)).count() == 0


def test_edits_are_nearer_than_neighbours(spark):
    r = queries.op1_multiset_hash(spark, SMALL).toPandas()
    assert (r.near_edited > r.near_next).mean() > 0.95


def test_toxicity_learns_what_sets_rows_apart(spark, documents):
    rng = random.Random(3)
    plain = lambda: " ".join("".join(rng.choice(["an", "er", "the", "ti", "on", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200)))
    foul = lambda: " ".join(w if rng.random() > 0.08 else rng.choice(["blockhead", "nitwit", "dimwitted"]) for w in plain().split())
    rows = [(i, foul() + " nitwit" if i % 4 == 0 else plain()) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = toxicity.learned(docs, labels.where(~toxicity.held_out()))
    out = toxicity.scored(docs, model).withColumn("out", toxicity.held_out()).collect()
    held = [r for r in out if r.out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.97


def test_toxicity_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 1), (5, 1, 0), (None, 1, 1), (7, None, None), (7, 1, 0), (4, 0, 1), (0, 0, 0)], none.schema)
    for labels in (none, some):
        rows = toxicity.scored(odd.withColumn("SCORE", F.lit("x")), toxicity.learned(odd, labels)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    empty = odd.limit(0)
    assert toxicity.scored(empty, toxicity.learned(empty, some)).count() == 0


def slow_score(model, text):
    """The score by its definition: lengths of every window under both dictionaries, features, logistic threshold."""
    import math

    import zstandard

    def length(content, w):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(w))

    x = []
    for start in (0, 32):
        saved = [length(model.ordinary, w) - length(model.ordinary + model.toxic, w) for w in toxicity.windows(text[start:])]
        if not saved:
            x += [0.0] * 12
            continue
        top = sorted([s for s in saved if s > 0], reverse=True)
        x += [top[i] if i < len(top) else 0 for i in range(3)]
        x += [sum(saved) / len(saved), sum(s for s in top if s >= 3) / math.sqrt(len(saved))]
        x += [math.log(1 + len([s for s in saved if s >= k])) for k in (2, 3, 4, 5, 6, 8)] + [math.log(1 + len(saved))]
    return 1 / (1 + math.exp(-sum((v - m) / d * w for v, m, d, w in zip(x, model.mean, model.scale, model.weight, strict=True)) - model.bias))


def test_scores_equal_their_definition(spark, documents):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["anti", "here", "other", "ones", "blockhead" if i % 3 == 0 else "tion"]) for _ in range(rng.randint(5, 120)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (1002, rows[0][1]), (1003, "other ones " * 4000)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = documents(rows, Score="clash")
    model = toxicity.learned(docs, labels.where(~toxicity.held_out()))
    assert model.ordinary and model.toxic
    found = sorted(((r.doc_id, r.score) for r in toxicity.scored(docs, model).collect()))
    want = sorted((i, slow_score(model, t or "")) for i, t in rows)
    assert [i for i, _ in found] == [i for i, _ in want]
    assert np.allclose([s for _, s in found], [s for _, s in want])


def test_windows_hold_the_whole_text():
    for text in ("", "a", "word " * 500, "x" * 1000, "ü" * 333 + " b"):
        cut = toxicity.windows(text)
        assert b"".join(cut).replace(b" ", b"") == text.encode().replace(b" ", b"")
        assert all(len(w) <= 2 * toxicity.WINDOW for w in cut)


def brute_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}
            if fine[kind]():
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789@.+- ()aZ_%", "..", "1.2.3.4", "255.", "4111 1111 1111 1111", "x@y.zz", "\n", "é", "٣", "+1 (555) 123-4567"]), max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary, edges, kinds = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]]), np.array([0, 1, 0])
    pairs = rng.normal(size=(2, 3, 3))
    pairs += pairs.transpose(0, 2, 1)
    total = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(pairs[k][y[a], y[b]] for (a, b), k in zip(edges, kinds, strict=True)))
        for i in range(4):
            total[i, y[i]] += w
    assert np.allclose(pii.pass_messages(unary, edges, kinds, pairs, rounds=200), total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_field_finds_repeated_numbers_and_spares_others(spark, documents):
    rng = random.Random(2)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"call +1 {number()} or write u{i}@mail.example.com today, order {rng.randint(10, 99999)}") for i in range(300)]
    again = number()
    rows += [(1000, f"ring +1 {again} now\nlater ring {again} again, room 4711"), (1001, "nothing personal in 2024, 37 words"), (1002, None)]
    out = {r.doc_id: r for r in pii.personal_data(documents(rows), redacted="clean").collect()}
    assert [(s.kind, rows[300][1][s.start : s.end]) for s in out[1000].spans] == [("phone", f"+1 {again}"), ("phone", again)]
    assert out[1000].clean == "ring <PHONE> now\nlater ring <PHONE> again, room 4711"
    assert out[1001].spans == [] and out[1002].spans == []
    assert all(len(out[i].spans) == 2 for i in range(300))


def test_personal_data_odd_rows(odd):
    rows = pii.digests(pii.personal_data(odd.withColumn("BASE", F.lit("x")))).collect()
    assert len(rows) == len(ODD)
    assert [r.n_phone for r in rows if r.doc_id == 6] == [1]
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_words(documents):
    rows = documents([(0, None), (1, ""), (2, " \t"), (3, " a\vb\fc \x85d "), (4, "x")]).select("doc_id", common.word_count("text").alias("n")).collect()
    assert [r.n for r in sorted(rows)] == [0, 0, 0, 3 + 1, 1]


def test_repeats_far_from_what_was_observed():
    """A number observed once is sure at its fortieth repeat; so is the far end of a path of like tokens."""
    text = "ring +1 (555) 123-4567 now " + " ".join(f"word and\nthen ({i % 2 + 5}55) 123-4567 or {'x' * 5}" for i in range(40))
    found = pii.tokens_of(text, pii.base_spans(text))
    observed = [i for i, y in enumerate(found.labels) if y > 0]
    repeats = [i for i, (a, b) in enumerate(found.spans) if text[a:b] == "123-4567"]
    hubs = {a if b == i else b for i in repeats for a, b, kind in found.edges if kind == pii.EQUAL and i in (a, b)}
    assert len(repeats) == 41 and hubs & set(observed)
    n = 41
    unary = np.zeros((n, len(pii.LABELS)))
    unary[0, 4] = 100.0
    agree = np.log(np.where(np.eye(len(pii.LABELS)) > 0, 0.9999, 0.0001 / 4))
    path = np.array([[i, i + 1] for i in range(n - 1)])
    p = pii.pass_messages(unary, path, np.ones(n - 1, np.int64), np.stack([agree, agree]))
    assert p[40, 4] > 0.99


@pytest.mark.parametrize("seed", range(6))
def test_marginals_on_loops_are_near_brute_force(seed):
    """Chain and skip edges that close loops: marginals near those of all labellings, and the same best labels."""
    rng = np.random.default_rng(seed)
    n, k = 6, 3
    edges = np.array([[i, i + 1] for i in range(n - 1)] + [[0, 3], [1, 4], [0, 5]])
    kinds = np.array([0] * (n - 1) + [1] * 3)
    unary, pairs = 2 * rng.normal(size=(n, k)), 0.5 * rng.normal(size=(2, k, k))
    pairs = (pairs + pairs.transpose(0, 2, 1)) / 2 + 0.5 * np.eye(k)
    total = np.zeros((n, k))
    for y in np.ndindex(*[k] * n):
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pairs[c][y[a], y[b]] for (a, b), c in zip(edges, kinds, strict=True)))
        for i in range(n):
            total[i, y[i]] += w
    want, got = total / total.sum(axis=1, keepdims=True), pii.pass_messages(unary, edges, kinds, pairs)
    assert np.abs(got - want).max() < 0.1 and (got.argmax(axis=1) == want.argmax(axis=1)).all()
    near, met, _ = pii.expectations(unary, edges, kinds, pairs, np.zeros((2 * len(edges), k)), 200)
    assert np.allclose(near, got, atol=1e-3) and np.allclose(met.sum(axis=(1, 2)), [n - 1, 3])


@pytest.mark.parametrize("share", [0.1, 1.0])
def test_planted_repeats_are_found_in_the_corpus_that_the_field_learns_from(share):
    """Phone numbers, once more without their plus sign, in a tenth or in all of the documents that hold one."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows, planted = [], {}
    for i in range(600):
        words = [word() for _ in range(60)]
        words[rng.randrange(20)] = f"{rng.randrange(10**16):016d}" if i % 3 else str(rng.randint(1900, 2100))
        if i % 2:
            number = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
            words[30] = number
            if rng.random() < share:
                planted[i] = number[1:]
                words.append(number[1:])
        elif i % 10 == 0:
            words[40] = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"  # nobody says what that is
        rows.append(" ".join(words))
    field = pii.fit([pii.lesson(t) for t in rows])
    base = [pii.base_spans(t) for t in rows]
    added = field.added(rows, base)
    found = [any(rows[i][a:b] == planted[i] and kind == "phone" for a, b, kind in added[i]) for i in planted]
    assert np.mean(found) > 0.9
    assert sum(bool(added[i]) for i in range(600) if i not in planted) <= 3


def test_tokens_are_read_whole():
    """Neither long tokens nor long runs without a blank hide anything behind their first characters."""
    dots = pii.tokens_of("." * 5000 + "4111x", [])
    assert [b - a for a, b in dots.spans] == [5]
    assert pii.shape("1-" * 200) != pii.shape("1-" * 200 + "9999")
    packed = "{" + ",".join(f'"k{i}":"v{i}"' for i in range(2000)) + ',"phone":"+1 (555) 123-4567","again":"1 (555) 123-4567"}'
    found = pii.tokens_of(packed, pii.base_spans(packed))
    assert packed[slice(*found.spans[-1])] == "123-4567" and found.labels[-1] == -1
    assert any(kind == pii.EQUAL and found.labels[a] > 0 for a, b, kind in found.edges if b == len(found.spans) - 1)
    long = "7" * 300_000
    assert pii.tokens_of(f"{long} a@{long}", []).spans == [(0, 300_000), (300_001, 600_003)]


def test_personal_data_digests(documents):
    """Expected strings for what the contract fixes; nothing is added where nothing was learned."""
    text = "é x@y.zz, 10.0.0.255 or 4111 1111 1111 1111; +1 (555) 123-4567"
    spans = "email:2:8,ip:10:20,card:24:43,phone:45:62"
    r = pii.digests(pii.personal_data(documents([(1, text)]))).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 1, 1, 1, spans)
    assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_columns_of_any_name_and_long_texts(documents):
    """Fingerprints, edits and token counts beside columns named like theirs; n_bytes and over_limit by the library."""
    rows = [(0, "one two\nthree"), (1, None), (1, None), (2, "é" * 3000), (3, "long words here " * 5000)]
    docs = documents(rows, FINGERPRINT=1, _block=2, _ahead=3, _key="k", near_next=4, N_Tokens=5, n_bytes=6)
    found = fingerprints.fingerprints(docs).collect()
    assert len(found) == 5 and {r.fingerprint for r in found if r.text is None} == {fingerprints.to_text(np.zeros(fingerprints.LANES, np.uint32))}
    edited = sorted(fingerprints.edited_with_next(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_chars) for r in edited] == [(0, 13), (1, 0), (1, 0), (2, 3000), (3, 80_000)]
    counted = token_counts.token_counts(docs.select("*", token_counts.n_bytes("text").alias("bytes")), BYTE, n_tokens="n").collect()
    for r in counted:
        n = len(library[BYTE].encode(r.text or "", add_special_tokens=False))
        assert (r.bytes, r.n, r.n > 1024) == (len((r.text or "").encode()), n, n > 1024)
