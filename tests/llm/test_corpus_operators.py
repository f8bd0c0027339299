"""Sharding, neighbours, mixing, near-duplicates, scores and the pipeline against brute force."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import ann, mixing, ngram_scores, queries, sharding, simhash

from .conftest import ODD, SMALL
from .test_text_operators import brute_spans

# near-duplicates


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >> 63 else out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "É", " ", "\n", "\x1c", "日本", "word"]), max_size=12).map("".join), max_size=4))
def test_simhash_equals_its_definition(texts):
    assert simhash.simhashes(texts) == [slow_simhash(t) for t in texts]


def test_shingle_hash_is_sparks(spark):
    r = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert int.from_bytes(simhash.shingle_hashes("A b\tC")[0], "big", signed=True) == r


def test_golay_code_is_perfect_and_keys_meet():
    remainder, table, sizes = simhash.golay_tables()
    assert sizes.sum() == sum(len(list(itertools.combinations(range(23), w))) for w in range(5))
    assert all((simhash.near_codewords(np.arange(1 << 12) << 11 | 0)[:, 0] >= 0).tolist())
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 3000, dtype=np.int64)
    other = base.copy()
    for i in range(len(other)):
        for b in rng.choice(64, rng.integers(1, 3), replace=False):
            other[i] ^= np.int64(-(1 << 63) if b == 63 else 1 << int(b))
    ka, ra, oa = simhash.golay_keys(base)
    kb, rb, _ = simhash.golay_keys(other)
    own = {(k, r) for k, r, o in zip(ka.tolist(), ra.tolist(), oa.tolist(), strict=True) if o}
    assert {r for k, r in zip(kb.tolist(), rb.tolist(), strict=True) if (k, r) in own} == set(range(len(base)))


def closure(fingerprints):
    root = list(range(len(fingerprints)))
    for i, j in itertools.combinations(range(len(fingerprints)), 2):
        if bin((fingerprints[i] ^ fingerprints[j]) & (1 << 64) - 1).count("1") <= 2:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("paired", [0, 2, 1000])
def test_links_close_to_the_same_components(spark, paired):
    rng = random.Random(4)
    words = [rng.getrandbits(63) for _ in range(6)] + [0, -1]
    for _ in range(120):
        w = rng.choice(words)
        for _ in range(rng.randint(1, 3)):
            b = rng.randrange(64)
            w ^= 1 << b if b < 63 else -(1 << 63)
        words.append(w)
    words = sorted(set(words))
    found = simhash.links(spark.createDataFrame([(w,) for w in words], "fp long"), "fp", paired=paired).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in found if paired == 1000)
    root = list(range(len(words)))
    at = {w: i for i, w in enumerate(words)}
    for r in found:
        a, b = root[at[r.a]], root[at[r.b]]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert root == closure(words)


def test_near_duplicates_every_row(documents):
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(400)]
    rows = [(100 + i, " ".join([*base[:k], f"new{i}", *base[k:]])) for i, k in enumerate(rng.sample(range(400), 12))]
    rows += [(500 + i, " ".join(base)) for i in range(40)] + ODD
    docs = documents(rows, FP=1, Component="x")
    found = simhash.near_duplicates(docs).collect()
    prints = [slow_simhash(t or "") for _, t in rows]
    roots = closure(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((str(i), p, str(least[r])) for (i, _), p, r in zip(rows, prints, roots, strict=True)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.deduplicated(docs.limit(0)).count()


# mixing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 4), min_size=1, max_size=12), st.floats(0, 1))
def test_budget_is_met_as_nearly_as_lengths_allow(counts, part):
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    total = int((lengths * n).sum())
    budget = round(part * total)
    take = mixing.fit_budget(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all()
    sums = {0}
    for size, most in counts.items():
        sums = {s + k * size for s in sums for k in range(most + 1)}
    assert abs(budget - int((lengths * take).sum())) == min(abs(budget - s) for s in sums)


@pytest.mark.parametrize(
    ("counts", "budget"),
    [({100003: 1, 100019: 1, 150001: 1, 90001: 1, 80021: 1}, 180040), ({70001: 3, 65537: 2, 99991: 4, 131071: 1}, 300_000), ({200_000: 5, 300_000: 3, 7: 1}, 900_003), ({66_000 + 6 * i: 1 for i in range(12)}, 401_000), ({1_000_003: 2, 3: 30_000}, 1_050_001)],
)
def test_budgets_of_long_documents_are_met_exactly(counts, budget):
    """Lengths beyond the program's first window: as near as any choice comes."""
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    take = mixing.fit_budget(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all()
    sums = {0}
    for size, most in counts.items():
        sums = {s + k * size for s in sums for k in range(most + 1)}
    assert abs(budget - int((lengths * take).sum())) == min(abs(budget - s) for s in sums)


def test_choice_is_the_same_whether_halved_or_not(monkeypatch):
    rng = np.random.default_rng(9)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 5000, 12))
        counts = rng.integers(1, 5, len(lengths))
        budget = int((lengths * counts).sum() * rng.random())
        want = mixing.fit_budget(lengths, counts, budget)
        monkeypatch.setattr(mixing, "LEVELS", 1000)
        assert (mixing.fit_budget(lengths, counts, budget) == want).all()
        monkeypatch.undo()


def slow_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        out |= {s: 2.0 * sizes[s] for s in over} if over else share
        rest -= sum(2.0 * sizes[s] for s in over)
        free = free - set(over) if over else set()
    return out


def test_mixture_against_slow_targets(documents):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "é", "z", None, "", "A"])) for i in range(500)]
    rows += [(900 + i, "hot text of five words", "a") for i in range(300)] + [(i if i is None else i + 3000, t, "odd") for i, t in ODD] + [(2000, None, "empty")]
    docs = documents(rows, SIZE="clash", _hash=1, target=0)
    out = mixing.mixture(docs)
    found = out.join(docs.select("doc_id", F.col("source").alias("s")).distinct(), out.doc_id.eqNullSafe(docs.doc_id)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = slow_targets(sizes), {}
    for r in found:
        assert r.source_size == sizes[r.s] and r.target == pytest.approx(want[r.s]) and r.taken <= 2 * r.size
    for r, (_, _, s) in zip(sorted(out.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id), sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), strict=True):
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= (1 if s != "odd" else 20_000) for s in want)
    assert out.exceptAll(mixing.mixture(docs.repartition(7))).count() == 0
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    assert made.count() == sum(r.taken // r.size for r in out.collect() if r.size) + made.where("trim(translate(coalesce(text, ''), '\n\t', '  ')) = ''").count()
    assert mixing.mixture(docs.limit(0)).count() == 0 == mixing.mixed(docs.limit(0)).count()


# sharding


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_even_and_keep_groups(documents, shards):
    rng = random.Random(7)
    rows = [(10 + i, f"text {rng.randrange(300)}") for i in range(700)] + [(1000 + i, "hot") for i in range(400)] + ODD
    docs = documents(rows, size=1, SHARD="x", cell=2)
    found = sharding.sharded(docs, shards=shards).collect()
    assert len(found) == len(rows)
    places = {}
    for r in found:
        places.setdefault(r.shard, []).append(r.slot)
    counts = [len(places.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    groups = {}
    for r in found:
        groups.setdefault(r.group, []).append(r.shard)
    small = [g for g in groups.values() if 1 < len(g) <= 10]
    assert np.mean([len(set(g)) == 1 for g in small]) > 0.9
    assert sharding.sharded(docs.limit(0), shards=shards).count() == 0
    sizes = {r.doc_id: r.size for r in found}
    assert (sizes[0], sizes[1], sizes[6]) == (1, 1, len(dict(ODD)[6].encode()) + 1)


def spark_hash(*values):
    """Spark's xxhash64: ("i", number) are 4 bytes, other numbers 8; null changes nothing."""
    import struct

    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def slow_shards(rows, shards, rounds=8):
    """Label propagation by plain loops over cells, then over rows: (id, crc) -> sorted (shard, slot)."""
    import zlib

    unsigned = lambda x: x % (1 << 64)
    chance = lambda *v: (unsigned(spark_hash(*v)) >> 11) / float(1 << 53)
    full = []
    for i, t in rows:
        t = t or ""
        crc = zlib.crc32(t.encode())
        full.append((i, len(t.encode()) + 1, crc, spark_hash(t), spark_hash(("i", 3), i, crc) % 1024))
    limit = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    cells = {}
    for *_, g, c in full:
        cells[g, c] = cells.get((g, c), 0) + 1
    members = {}
    for (g, _), n in cells.items():
        members[g] = members.get(g, 0) + n
    state = {(g, c): c % shards for g, c in cells if members[g] > 1}
    for turn in range(rounds):
        load = [0] * shards
        for k, s in state.items():
            load[s] += cells[k]
        open_ = [s for s in range(shards) if load[s] < 0.98 * limit[s]]
        if not open_:
            break
        tally = {}
        for (g, c), s in state.items():
            tally.setdefault(g, {}).setdefault(s, 0)
            tally[g][s] += cells[g, c]
        want = {}
        for g, by in tally.items():
            some = [((n, spark_hash(g, ("i", s))), s) for s, n in by.items() if s in open_]
            want[g] = max(some)[1] if some else open_[spark_hash(g) % len(open_)]
        large = {g: members[g] > max(limit) / 2 for g in tally}
        goal = {(g, c): s if large[g] and s not in open_ else want[g] for (g, c), s in state.items()}
        flow = {}
        for k, s in state.items():
            if s != goal[k]:
                flow[s, goal[k]] = flow.get((s, goal[k]), 0) + cells[k]
        share = sharding.quotas(flow, load, limit)
        if not any(share[e] * n >= 1 for e, n in flow.items()):
            break
        state = {(g, c): goal[g, c] if s != goal[g, c] and chance(("i", turn), g, *([("i", c)] if large[g] else [])) < share.get((s, goal[g, c]), 0.0) else s for (g, c), s in state.items()}
    near = [state.get((g, c), shards) for *_, g, c in full]
    order = [spark_hash(("i", 5), g, ("i", c)) for *_, g, c in full]
    load = [near.count(s) for s in range(shards + 1)]
    kept = [min(load[s], limit[s]) for s in range(shards)]
    out, loose = {}, []
    for s in range(shards + 1):
        mine = sorted((j for j in range(len(full)) if near[j] == s), key=lambda j: (unsigned(order[j]) >> 54, order[j], full[j][0] is not None, full[j][0] or 0, full[j][2], full[j][1]))
        stay = kept[s] if s < shards else 0
        for rank, j in enumerate(mine[:stay]):
            out.setdefault((full[j][0], full[j][2]), []).append((s, rank))
        loose += mine[stay:]
    free = [(s, slot) for s in range(shards) for slot in range(kept[s], limit[s])]
    for j, place in zip(loose, free, strict=True):
        out.setdefault((full[j][0], full[j][2]), []).append(place)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("shards", [3, 16])
def test_shards_equal_brute_force(documents, shards):
    rng = random.Random(17)
    rows = [(10 + i, f"text {rng.randrange(150)}") for i in range(500)] + [(1000 + i, "hot") for i in range(250)] + ODD
    found = {}
    for r in sharding.sharded(documents(rows), shards=shards).collect():
        found.setdefault((r.doc_id, r.text_crc32), []).append((r.shard, r.slot))
    assert {k: sorted(v) for k, v in found.items()} == slow_shards(rows, shards)


def test_quotas_respect_limits():
    flow = {(0, 1): 50, (2, 1): 50, (1, 0): 10}
    share = sharding.quotas(flow, [40, 40, 40], [60, 60, 60])
    assert 40 + share[0, 1] * 50 + share[2, 1] * 50 - share[1, 0] * 10 <= 61
    assert sharding.quotas({(0, 1): 5}, [5, 9], [9, 9])[0, 1] == 0


# neighbours


def slow_neighbours(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 4]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for i in {i for i, _ in good if i % every == 0}:
        mine = [v for j, v in good if j == i]
        best = {}
        for q in mine:
            for j, v in good:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), round(float(q @ v), 9))
        out[i] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(90)] + [(200 + i, [1.0, 0.0, 2.0, 0.5]) for i in range(60)] + [(20, [1.0, 0.0, 2.0, 0.5])]
    rows += [(300, None), (301, [0.0] * 4), (302, [None, 1.0, 1.0, 1.0]), (303, [float("nan"), 1.0, 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0, 1.0]), (305, [1.0]), (306, []), (None, [1.0] * 4), (4, rows[4][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = {}
    for r in ann.neighbours(table, every=20, k=20, list_size=10_000).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, round(r.score, 9))
    want = slow_neighbours(rows, 20, 20)
    assert {q: [x[i] for i in sorted(x)] for q, x in found.items()} == want
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert ann.neighbours(few).count() == 4
    assert ann.neighbours(table.limit(0)).count() == 0


def test_lists_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.neighbours(table, list_size=50).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in range(0, 3000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20].tolist()) & found[i]) / 20)
        assert len(found[i]) == 20
    assert np.mean(hits) >= 0.9


# scores


def test_scores_equal_sql(spark, documents):
    rows = ODD[:9] + [(10, "a b c a b"), (11, "a b d"), (12, "a b c a b"), (13, "never seen words"), (14, "the same words")]
    found = ngram_scores.scored(documents(rows, SLICE=1, n_words="x")).toPandas()
    import pandas as pd

    documents_ = pd.DataFrame(rows, columns=["doc_id", "text"])
    c = duckdb.connect()
    c.register("documents", documents_)
    want = c.sql(ngram_scores.ORACLE).df()
    key = lambda d: sorted(zip(d.n_words, d.n_seen, d.log_score.round(4), strict=True))
    assert np.allclose(key(found), key(want))
    assert ngram_scores.scored(documents(rows).limit(0)).count() == 0


def test_longer_contexts_by_hand(documents):
    docs = documents([(0, "a b c"), (1, "a b c"), (2, "a b d")])
    rows = {r.doc_id: r for r in ngram_scores.scored(docs, order=3).collect()}
    # among the other two: a begins both, b follows a in both, c follows "a b" in one
    assert rows[0].log_score == pytest.approx(np.log(2 / 2) + np.log(2 / 2) + np.log(1 / 2))
    assert rows[2].log_score == pytest.approx(np.log(1) + np.log(1) + 2 * np.log(0.4) + np.log(0.4) - np.log(7))


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (ngram_scores.unpack_keys(ngram_scores.pack_keys(keys)) == keys).all()
    at = ngram_scores.bounds(keys, 7)
    assert at[0] == 0 and at[-1] == len(keys) and all(int(k) * 7 >> 64 == p for p in range(7) for k in keys[at[p] : at[p + 1]])


# near copies of the pipeline


def like(texts, width=5, least=0.8):
    """For each text the first one of its group: the closure of all pairs whose sets of word shingles are similar enough."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if root[i] != root[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


# registered queries and the pipeline


def test_every_query_returns_a_row_for_each_document(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name, query in queries.queries().items():
        rows = query(spark, SMALL)
        if name.startswith("op4_"):
            assert rows.count() == 20 * spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 20 = 0").count()
        else:
            assert rows.select("doc_id").distinct().count() == rows.count() == n, name


def test_pipeline_stages(spark, documents):
    names = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    docs = documents([(1000 + i, t) for i, t in [(0, None), (1, ""), (2, "write to a.b@mail.example.com please"), (3, "some words"), (4, "some words")]])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "personal data", "mix", "tokens"]
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert (out.columns == names) == (name != "tokens")
        texts[name] = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect())
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert len(texts["toxicity"]) == 5
    assert [i for i, *_ in texts["near-duplicates"]] == [1000, 1002, 1003]
    assert texts["personal data"][2] == (1002, "write to <EMAIL> please", 23) and texts["personal data"][0] == (1000, None, None)
    assert {t for _, t, _ in texts["mix"]} <= {t for _, t, _ in texts["toxicity"]}
    assert corpus_pipeline.run(spark, SMALL).columns == [*names, "ids", "decoded"]


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input, by plain loops: scores, closure of fingerprints, spans, targets, the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from chronoweave.llm import pii, toxicity

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: tuple(str(x) for x in r)

    def staged(name, rows):
        return sorted((tuple(r) for r in stages[name](spark, spark.createDataFrame(rows, docs.schema), SMALL).collect()), key=key)

    scorer = toxicity.learned(docs, labels.where(~toxicity.held_out())).scorer()
    scores = scorer.scores([r[1] or "" for r in rows])
    want = sorted((r for r, s in zip(rows, scores, strict=True) if s < 0.5), key=key)
    got = staged("toxicity", rows)
    assert got == want and len(got) < len(rows)

    roots = like([r[1] or "" for r in got])
    kept = {root: min(r[0] for r, x in zip(got, roots, strict=True) if x == root) for root in set(roots)}
    want = [r for r, root in zip(got, roots, strict=True) if kept[root] == r[0]]
    got = staged("near-duplicates", got)
    assert got == want

    field = pii.trained(spark.createDataFrame(got, docs.schema), "text", 2000, 7)
    texts = [r[1] or "" for r in got]
    base = [brute_spans(t) for t in texts]
    spans = [sorted([*b, *more], key=lambda s: (s[0], pii.KINDS.index(s[2]))) for b, more in zip(base, field.added(texts, base), strict=True)]
    clean = [pii.redact(t, s) for t, s in zip(texts, spans, strict=True)]
    want = sorted(((r[0], c if r[1] is not None else None, r[2], r[3], len(c) if s else r[4]) for r, c, s in zip(got, clean, spans, strict=True)), key=key)
    got = staged("personal data", got)
    assert got == want

    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    sizes, taken, copies = {}, {}, {}
    for r in got:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r)
    mix = staged("mix", got)
    for r in mix:
        taken[r[3]] = taken.get(r[3], 0) + size(r)
        copies[r] = copies.get(r, 0) + 1
    assert set(copies) <= set(got) and max(copies.values()) <= 2
    for source, target in slow_targets(sizes).items():
        lengths = [size(r) for r in got if r[3] == source]
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        base_words = int(target // sizes[source]) * sizes[source] if sizes[source] else 0
        assert abs(taken.get(source, 0) - target) <= min(abs(base_words + s - target) for s in sums) + 1

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = stages["tokens"](spark, spark.createDataFrame(mix, docs.schema), SMALL).collect()
    assert sorted((tuple(r[:5]) for r in out), key=key) == mix
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, library.decode(ids, skip_special_tokens=False))


def test_near_copies_reach_similarity_by_brute_force(spark, documents):
    """Texts with a few words replaced; the stage keeps as many as the closure of all pairs of similarity 0.8 leaves."""
    rng = random.Random(8)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((10 * g, " ".join(words)))
        for j in range(1, rng.randint(2, 6)):
            copy = list(words)
            for at in rng.sample(range(300), rng.randint(1, 9)):
                copy[at] = f"x{rng.randrange(5000)}"
            rows.append((10 * g + j, " ".join(copy)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for _, t in rows]
    root, linked, far = list(range(len(rows))), 0, 0
    prints = simhash.simhashes([t for _, t in rows])
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            linked += 1
            far += bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") > 2
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    assert far > linked / 2  # the contract rule of op7 misses them
    kept = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, documents(rows), SMALL).collect()
    assert sorted(r.doc_id for r in kept) == [rows[i][0] for i in sorted(set(root))]


def test_copies_of_one_id_leave_room_for_other_ids(spark):
    v = [1.0, 0.0, 2.0, 0.5]
    table = spark.createDataFrame([(0, v)] * 30 + [(i, v) for i in (1, 2, 3)], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in ann.neighbours(table).collect() if r.query_id == 0} == {1, 2, 3}


def test_blocks_join_what_all_pairs_join(spark):
    """Whatever the size of blocks: the closure of all similar pairs of a key, with as many links as rows at most."""
    from chronoweave.llm import near_copies

    rng = random.Random(3)
    base = [[f"b{g}w{i}" for i in range(80)] for g in range(6)]
    texts = []
    for i in range(120):
        words = list(base[i % 6])
        for at in rng.sample(range(80), rng.randint(0, 4)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    _, _, sigs, _ = near_copies.signatures(texts)
    rows = [(i % 2, 1000 + i, 5000 + i, sigs[i], near_copies.shingle_set(t).tobytes()) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "key long, fp long, class long, sig binary, shingles binary")
    for block in (10, 1000):
        found = near_copies.in_blocks(table, block=block).collect()
        for key in (0, 1):
            mine = [i for i in range(120) if i % 2 == key]
            root = {1000 + i: 1000 + i for i in mine}
            for r in found:
                if r.a in root:
                    a, b = root[r.a], root[r.b]
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
            assert [root[1000 + i] for i in mine] == [1000 + mine[x] for x in like([texts[i] for i in mine])]
        assert block < 1000 or len(found) < 120


def test_large_buckets_are_compared_whole(spark, documents, monkeypatch):
    """Texts of one template, in groups that are near each other but not near the centres: as the closure of all pairs."""
    from chronoweave.llm import near_copies

    monkeypatch.setattr(near_copies, "PAIRED", 2)
    monkeypatch.setattr(near_copies, "CENTRES", 1)
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(120)]
    rows = []
    for g in range(12):
        own = [f"g{g}x{j}" for j in range(60)]
        for k in range(3):
            words = shared + own
            words[rng.randrange(180)] = f"new{g}{k}"
            rows.append((10 * g + k, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " ")]
    got = {r.doc_id: r.component_id for r in near_copies.similar(documents(rows, FP=1)).collect()}
    roots = like([t or "" for _, t in rows])
    assert got == {i: min(j for (j, _), x in zip(rows, roots, strict=True) if x == root) for (i, _), root in zip(rows, roots, strict=True)}
    assert len(set(got.values())) == 13


def test_pipeline_stages_keep_columns_of_any_name(spark, documents):
    """Names that stages use themselves, nulls in every column, repeated rows, a long text."""
    clash = {"_score": 1, "score": "s", "_Base": 2, "spans": 3, "_redacted": 4, "_row": 5, "size": 6, "_hash": 7, "_copies": 8, "_source": 9, "T": 10, "i": 11, "fp": 12, "IDS2": 13}
    rows = [(1, "write to a.b@mail.example.com now"), (1, "write to a.b@mail.example.com now"), (2, None), (None, "no id here at all"), (3, "word " * 30_000), (4, "")]
    docs = documents(rows, **clash).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") > 1, F.col("source")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns[: len(docs.columns)] == docs.columns if name == "tokens" else out.columns == docs.columns, name
        got = out.collect()
        assert got and all(tuple(r[c] for c in clash) == tuple(clash.values()) for r in got), name


def test_shards_of_one_hot_group_and_of_none(documents):
    """All rows equal, and all different: counts stay even, and a column that is named like a result does not matter."""
    for rows in ([(i, "same") for i in range(100)], [(i, f"text {i}") for i in range(100)]):
        found = sharding.sharded(documents(rows, n=1, members=2, Group="x", near=3)).collect()
        counts = [sum(r.shard == s for r in found) for s in range(16)]
        assert sum(counts) == 100 and max(counts) - min(counts) <= 1
