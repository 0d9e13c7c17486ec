"""Near duplicates, importance resampling, exact search and the pipeline against brute force."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import common, components, minhash, resample, topk
from quillmatch.llm.wordhash import SPACES, TEXT, word_hashes

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def shingle_set(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute_groups(docs, k, percent=80):
    sets = {}
    for d, t in docs:
        sets.setdefault(d, shingle_set(t, k))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed=4, families=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, i = [], 0
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 30, 120]))]
        for _ in range(rng.choice([1, 2, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append((i, " ".join(own) + rng.choice(["", " ", "\n"])))
            i += 1
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs += [(i + j, shared + " " + " ".join(rng.choice(vocabulary) for _ in range(60))) for j in range(40)]
    return [*docs, (9001, None), (9002, ""), (9003, " \t "), (9004, "One"), (9005, "one"), (9006, "word " * 20_000)]


@pytest.mark.parametrize("split", [minhash.SPLIT, 4])
def test_groups_against_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(minhash, "SPLIT", split)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    docs = corpus()
    df = spark.createDataFrame([(*d, "k", "c") for d in docs], "doc_id long, text string, key string, component_id string").repartition(3)
    got = minhash.near_duplicates(df, words=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(docs, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


LONG = [f"w{i}" for i in range(40)]
A, A_NEAR, B, B_NEAR, C = " ".join(LONG), " ".join([*LONG, "end"]), " ".join(LONG[::-1]), " ".join([*LONG[::-1], "end"]), "other words stand here alone"


def groups_by_rows(rows, k=5):
    """What is promised of near_duplicates: (doc_id, n_shingles, component_id) of each row, by brute force."""
    nodes = [("id", d) if d is not None else ("text", t) for d, t in rows]
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            near = n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n)
            if near or (nodes[i] == nodes[j] and sets[i] and sets[j]):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[j] and root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


CASES = {
    "null ids": [(None, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (None, C), (2, "A b c d e f")],
    "one id, two texts": [(5, A), (5, B), (6, A_NEAR), (7, B_NEAR)],
    "one id, two texts, of groups with other ids": [(9, A), (9, B), (4, A_NEAR), (3, B_NEAR), (2, C)],
    "one id, a text and none": [(5, A), (5, ""), (5, None), (6, A_NEAR)],
    "near texts without ids": [(None, A), (8, A_NEAR), (None, B), (None, B_NEAR), (None, B), (None, None), (None, " ")],
    "null id between two ids": [(7, " ".join([*LONG, "x", "y", "z", "end"])), (None, A_NEAR), (6, A)],
}


def all_cases(cases, turn):
    """The rows of all cases in one table: ids and words of a case are its own."""
    own = lambda t, n: t if not (t or "").strip() else " ".join(f"c{n}{w}" for w in t.split())
    return [(d if d is None else 100 * n + d, own(t, n)) for n, rows in enumerate(cases) for d, t in rows][::turn]


@pytest.mark.parametrize("turn", [1, -1])
def test_rows_that_share_or_lack_a_doc_id(spark, turn):
    rows = all_cases(CASES.values(), turn)
    got = [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted([r[:3] for r in got], key=str) == groups_by_rows(rows)
    assert all(r[3] == (r[0] == r[2]) for r in got)


STAYS = [  # rows, and those that stay
    ([(1, A), (1, A), (None, A), (2, A_NEAR), (None, A_NEAR)], [(1, A)]),
    ([(None, A), (None, A), (3, B)], [(3, B), (None, A)]),
    ([(5, ""), (5, A), (5, A), (6, " "), (6, " ")], [(5, A), (6, " ")]),
    ([(None, None), (None, None), (None, ""), (42, None), (43, C), (7, C)], [(7, C), (42, None), (None, ""), (None, None), (None, None)]),
]


@pytest.mark.parametrize("turn", [1, -1])
def test_one_row_of_each_group_stays(spark, turn):
    either = [[(None, A), (None, A_NEAR)], [(5, A), (5, B), (6, A_NEAR), (7, B_NEAR)]]
    rows = all_cases([r for r, _ in STAYS] + either, turn)
    got = [tuple(r) for r in minhash.deduplicate(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, id long")).collect()]
    surely = all_cases([r for _, r in STAYS], 1)
    rest = sorted((r[:2] for r in got), key=str)
    for r in surely:
        rest.remove(r)
    assert len(rest) == 2 and {d for d, _ in rest} == {None, 505} and all(r[2] == 0 for r in got)


def test_groups_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicate(none).count() == 0


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_hot_keys_are_joined_apart(spark, broadcast):
    rows = spark.createDataFrame([(i, 0 if i % 2 else i % 30, i % 7) for i in range(400)], "i long, f long, g long")
    of = rows.filter("f <> 4").groupBy("f", "g").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    got = common.joined_by_hot_keys(rows, of, ["f", "g"], hot=10, most=broadcast)
    assert got.columns == ["i", "f", "g", "m"]
    clashing = rows.withColumns({"__f": F.lit("x"), "__m": F.col("i"), "__large": F.lit(None), "__part": F.lit(1)})
    more = common.joined_by_hot_keys(clashing, of, ["f", "g"], hot=10, most=broadcast)
    assert more.columns == [*clashing.columns, "m"] and more.filter("`__m` <> i OR `__f` <> 'x'").isEmpty() and more.count() == 400
    plain = rows.join(of.drop("n"), ["f", "g"], "left").select("i", "f", "g", "m")
    assert sorted([tuple(r) for r in got.collect()]) == sorted([tuple(r) for r in plain.collect()], key=lambda r: r[:3])


def test_tiles_hold_every_pair_of_different_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(9)
    rows = [(key, 100 * key + i, rng.choice([0, 0, 0, 0, 1, 2, 3]), n) for key, n in ((1, 3), (2, 40), (3, 5)) for i in range(n)]
    tiles = minhash._tiles(spark.createDataFrame(rows, "key long, id long, comp long, n long")).collect()
    held = {}
    for t in tiles:
        held.setdefault((t["key"], t["i"], t["j"]), []).append((t["id"], t["x"]))
    for key, a, comp, _ in rows:
        for other, b, of, _ in rows:
            if key == other and a < b and comp != of:
                meet = [k for k, m in held.items() if k[0] == key and {a, b} <= {i for i, _ in m} and (k[1] == k[2] or dict(m)[a] != dict(m)[b] or k[1] == k[2])]
                assert len(meet) == 1
    main = max(set(r[2] for r in rows if r[0] == 2), key=[r[2] for r in rows if r[0] == 2].count)
    copies = [sum(t["id"] == i for t in tiles) for key, i, comp, _ in rows if key == 2 and comp == main]
    assert max(copies) < len({t["x"] for t in tiles if t["key"] == 2})


def test_pruning_keeps_pairs_at_the_threshold():
    least = minhash.least_matches(0.8)
    assert list(least) == list(range(16, 257, 16)) and sorted(least.values()) == list(least.values())
    rng = np.random.default_rng(1)
    near = rng.random((20_000, 256)) < 0.8
    a = np.zeros((20_000, 256), np.uint16)
    assert len(minhash.possible(a, (~near).astype(np.uint16), least)) >= 19_998
    far = rng.random((2_000, 256)) < 0.5
    assert len(minhash.possible(a[:2000], (~far).astype(np.uint16), least)) == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)
    a, b = minhash.signature(pool[:900]), minhash.signature(pool[100:])
    assert abs((a == b).mean() - 0.8) < 0.1


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_tell_words_apart():
    texts = ["One two  TWO", "", "two", "ab ba", "é e", "x" * 5000]
    h, n = word_hashes([t.encode() for t in texts], SPACES)
    assert n.tolist() == [3, 0, 1, 2, 2, 1]
    assert h[1] == h[2] == h[3] and len(set(h.tolist())) == 7
    assert word_hashes([b"a,b!! c"], TEXT)[1].tolist() == [5]


def brute_topk(vectors, every, k):
    import math

    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, list(v)) for i, v in {(i, tuple(v)) for i, v in good}]
    out = set()
    for i, q in good:
        if i % every == 0:
            ranked = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6])
def test_search_against_brute_force(spark, scale):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [scale * (c + rng.gauss(0, 0.2)) for c in centres[i % 4]]) for i in range(150)]
    rows += [(i, list(rows[0][1])) for i in range(150, 180)]  # equal vectors tie
    if scale == 1:
        rows += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [1.0] * 8), (504, []), (505, [1.0]), rows[3], (520, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    v = topk.quantised(df)
    got = {tuple(r) for r in topk.search(v, v.filter("vec_id % 5 = 0"), 20, candidates=16).collect()}
    assert got == brute_topk(rows, 5, 20)
    assert topk.search_embeddings(df.limit(0)).count() == 0


def test_rows_that_share_a_vector_id(spark):
    """Each is a candidate, and as queries they share the ranks."""
    rows = [(i, [i % 7, i % 5 - 2]) for i in range(60)] + [(0, [1, 1]), (0, [-1, 4]), (3, [9, 9])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, v array<long>, rank int")
    pairs = [(i, -sum(a * b for a, b in zip(q, v)), j) for i, q in rows if i % 20 == 0 for j, v in rows if j != i]
    expected = sorted((i, r + 1, j, -s) for q in (0, 20, 40) for r, (i, s, j) in enumerate(sorted(p for p in pairs if p[0] == q)[:5]))
    assert sorted(tuple(r) for r in topk.search(df, df.filter("vec_id % 20 = 0"), 5, candidates=8).collect()) == expected


@pytest.mark.parametrize("floors", [False, True])
def test_index_stops_before_its_last_segment(floors):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 12, (10, 64))
    v = np.floor(centres[rng.integers(0, 10, 3000)] + rng.normal(0, 2, (3000, 64))).astype(np.int64)
    index = topk.Index(v, np.arange(3000))
    assert index.postings == (v != 0).sum() == sum(len(rows) for rows, *_ in index.segments)
    edges = topk.edges_of(np.abs(v))
    assert edges == sorted(edges, reverse=True) and edges[-1] == 1 and len(edges) == 4
    s = v[:50] @ v.T
    s[np.arange(50), np.arange(50)] = -(10**9)
    floor = np.sort(s, axis=1)[:, -20].astype(float) if floors else None
    got = {q: (near, scores) for q, near, scores in index.search(v[:50], np.arange(50), 20, floor)}
    assert 0 < index.visited < 0.8 * index.postings * 50
    for q in range(50):
        order = np.lexsort((np.arange(3000), -s[q]))[:20]
        assert got[q][0].tolist() == order.tolist() and got[q][1].tolist() == s[q][order].tolist()


def test_kth_highest(spark):
    rng = random.Random(7)
    xs = [rng.choice([rng.gauss(0, 100), 5.0, -1e9]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 2, 100, 250, 499, 500):
        assert resample.kth_highest(df, "x", k, bins=7) == sorted(xs, reverse=True)[k - 1]
    assert resample.kth_highest(df, "x", 0) == float("inf") and resample.kth_highest(df.limit(0), "x", 3) == float("-inf")


def test_gumbel_keys_sample_by_weight():
    """Equal documents but for their ids: the highest key falls on a share that follows the weight."""
    model = resample.Model(np.log(np.where(np.arange(64) % 2, 2.0, 1.0)), seed=1)
    texts = [b"a", b"b", b"c", b"d"]
    wins = np.zeros(4)
    for i in range(2000):
        _, weight, key = model.keys([4 * i + j for j in range(4)], texts)
        wins[key.argmax()] += 1
    assert np.abs(wins / 2000 - np.exp(weight) / np.exp(weight).sum()).max() < 0.04


@needs_tables
def test_resampling_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit_on, held_out = labels.filter(F.xxhash64("doc_id") % 2 == 0), labels.filter(F.xxhash64("doc_id") % 2 != 0)
    got = resample.select_documents(docs, resample.good_labels(fit_on))
    assert got.count() == docs.count()
    rates = {r["quality"]: r["kept"] for r in held_out.join(got, "doc_id").filter("toxic = 0").groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.99 and rates[0] < 0.1


@needs_tables
def test_resampling_rejects_held_out_toxic_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit_on, held_out = labels.filter(F.xxhash64("doc_id") % 2 == 0), labels.filter(F.xxhash64("doc_id") % 2 != 0)
    got = held_out.join(resample.select_documents(docs, resample.good_labels(fit_on)), "doc_id").filter("quality = 1")
    rates = {r["toxic"]: r["kept"] for r in got.groupBy("toxic").agg(F.avg(F.col("selected").cast("int")).alias("kept")).collect()}
    assert rates[1] < 0.35 and rates[0] > 0.99


def test_toxicity_is_of_few_strong_buckets_in_any_length():
    model = resample.Model(np.zeros(64), seed=1, toxic=np.where(np.arange(64) % 2, 1.0, -1.0), limit=2.5)
    at, n = np.array([1, 1, 1, 3, 2, *[2] * 50, 1, 3, 5, 7, 9, 11]), np.array([5, 0, 56])
    assert model._toxicity(at, n).tolist() == [2.0, 0.0, 5.0]
    assert (resample.Model(np.zeros(64), seed=1)._toxicity(at, n) == 0).all()


def plain_resample(docs, good, buckets, shrink, seed, k, temperature):
    """Weights, keys and the selected rows, document by document; only the buckets of a text come from the operator."""
    import math

    own = {i: resample.features([(t or "").encode()], buckets)[0].tolist() for i, (_, t) in enumerate(docs)}
    raw, target = {}, {}
    for i, (d, _) in enumerate(docs):
        for b in own[i]:
            raw[b] = raw.get(b, 0) + 1
            if d in good:
                target[b] = target.get(b, 0) + 1
    sums = [[sum(n for b, n in c.items() if (b >= buckets) == half) for c in (raw, target)] for half in (False, True)]
    weight = {}
    for b, n in raw.items():
        all_raw, all_target = sums[b >= buckets]
        p = (target.get(b, 0) + shrink) / (all_target + shrink * buckets)
        q = (n * all_target / all_raw + shrink) / (all_target + shrink * buckets)
        weight[b] = math.log(p / q)
    mixed = lambda x: int(resample.mix(np.array([x % 2**64], np.uint64))[0])
    out = []
    for i, (d, _) in enumerate(docs):
        whole = sum(mixed(b) for b in own[i]) % 2**64
        u = (mixed(mixed((-1 if d is None else d) % 2**64 + seed) ^ whole) >> 11) / 2**53
        w = sum(weight[b] for b in own[i])
        out.append((d, len(own[i]), w, w / temperature - math.log(-math.log(min(max(u, 2.0**-54), 1 - 2.0**-53)))))
    floor = sorted((r[3] for r in out), reverse=True)[k - 1]
    return [(*r, r[3] >= floor - 1e-9) for r in out]


@pytest.mark.parametrize("temperature", [1.0, 50.0])
def test_resampling_against_plain_python(spark, temperature):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words[:40] if i % 3 else words[20:], k=rng.randrange(1, 60)))) for i in range(120)] + [(500, None), (501, ""), (None, "w1 w2"), (7, "w1")]
    labels = [(i, i % 3 == 0) for i in range(0, 90)]
    held = {r["doc_id"] for r in resample._sample(spark.createDataFrame(labels, "doc_id long, good boolean"), F.col("good"), 10**6, 0).collect() if r["role"] == 2}
    df = spark.createDataFrame([(*r, 0.0) for r in docs], "doc_id long, text string, key double")
    got = resample.select_documents(df, spark.createDataFrame(labels, "doc_id long, good boolean"), buckets=1 << 10, k=40, temperature=temperature)
    good = {i for i, g in labels if g} - held
    expected = plain_resample(docs, good, 1 << 10, resample.SHRINK, 17, 40, temperature)
    rounded = lambda r: (r[0], r[1], round(r[2], 6), round(r[3], 6), r[4])
    assert sorted([rounded(tuple(r)) for r in got.collect()], key=str) == sorted(map(rounded, expected), key=str)
    assert sum(r[4] for r in expected) == 40


@needs_tables
def test_sample_is_nearer_to_the_target_than_raw_text_and_than_the_heaviest(spark):
    """The divergence of word buckets from target text, of a tenth of the documents, weighed by a power of their ratio."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = resample.good_labels(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    got = resample.select_documents(docs, labels, k=1000, temperature=100.0)
    rows = docs.join(labels, "doc_id", "left").join(got, "doc_id").select("text", "good", "selected", "log_weight").collect()
    edge = sorted((r["log_weight"] for r in rows), reverse=True)[999]

    def spread(which):
        n = np.full(1 << 10, 0.5)
        for r in rows:
            if which(r):
                n += np.bincount(resample.features([(r["text"] or "").encode()], 1 << 10)[0] % (1 << 10), minlength=1 << 10)
        return n / n.sum()

    target = spread(lambda r: r["good"])
    far = lambda p: float((target * np.log(target / p)).sum())
    sampled, raw, heaviest = far(spread(lambda r: r["selected"])), far(spread(lambda r: True)), far(spread(lambda r: r["log_weight"] >= edge))
    print("divergence", sampled, raw, heaviest)
    assert sampled < heaviest and sampled < raw


def test_models_are_distributions():
    raw, target, shrink = np.array([5.0, 0, 2, 9]), np.array([1.0, 0, 2, 0]), 5.0
    expected = raw * target.sum() / raw.sum()
    p, q = (target + shrink) / (target.sum() + 4 * shrink), (expected + shrink) / (target.sum() + 4 * shrink)
    assert abs(p.sum() - 1) < 1e-12 and abs(q.sum() - 1) < 1e-12
    assert np.allclose(np.log(p / q), np.log((target + shrink) / (expected + shrink)))


def test_resampling_edges(spark):
    rows = [(1, "good text here"), (2, None), (3, ""), (None, "bad %%% bad"), (1, "good text here"), (4, "long " * 50_000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, key double")
    for labels in ([], [(1, True), (4, False), (None, True)]):
        l = spark.createDataFrame(labels, "doc_id long, good boolean")
        got = resample.select_documents(df, l).collect()
        assert len(got) == len(rows)
        model, _ = resample.fit(df, l)
        left = resample.keep(df, model)
        assert left.columns == df.columns and left.count() == sum(r["selected"] for r in got)
    nothing = resample.select_documents(df.limit(0), spark.createDataFrame([], "doc_id long, good boolean"))
    assert nothing.count() == 0


@needs_tables
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p
    from quillmatch.llm.common import written

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    one = written(p.quality(spark, docs, FOLDER), "t1")
    assert one.columns == docs.columns
    left = {r["doc_id"] for r in one.collect()}
    clean = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    low = [d for d, r in labels.items() if r["quality"] == 0]
    assert sum(d in left for d in clean) >= 0.99 * len(clean) and sum(d in left for d in low) <= 0.2 * len(low)

    two = written(p.near_duplicates(spark, one, FOLDER), "t2")
    groups = brute_groups([(r["doc_id"], r["text"]) for r in one.collect()], 5)
    assert {r["doc_id"] for r in two.collect()} == {d for d, (_, c) in groups.items() if d == c}

    three = written(p.benchmark_text(spark, two, FOLDER), "t3")
    from tests.llm.test_filters import brute_report

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    report = brute_report([(r["doc_id"], r["text"]) for r in two.collect()], bench)
    assert {r["doc_id"] for r in three.collect()} == {r[0] for r in report if not r[5]}

    four = p.pack(spark, three, FOLDER).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert {r["doc_id"] for r in four} == {r["doc_id"] for r in three.collect()} and all(r["n"] == r["of"] for r in four)
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "benchmark_text", "pack"]


def test_deduplicate_passes_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 77, "a", 1, 2), (1, text, 77, "a", 1, 2), (2, text + " more", 78, "b", 3, 4), (3, "other words stand here", 79, "c", 5, 6), (None, "", 80, "d", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __node long, __gone string, __again int, __row int")
    out = minhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
    assert minhash.deduplicate(df.limit(0)).count() == 0
