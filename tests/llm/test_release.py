"""Cascading release and vector codes against plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import codes, queries, release


def by_hand(rows):
    """{(conv_id, turn): outcome} of (conv_id, turn, text), straight from the rules."""
    h = lambda k, c, t: zlib.crc32(f"{k}:{c}:{t}".encode())
    texts, out = {}, {}
    for c, t, text in rows:
        crc = zlib.crc32((text or "").encode())
        texts[c, t] = min(crc, texts.get((c, t), crc))
    convs = defaultdict(list)
    for c, t in sorted(texts):
        convs[c].append(t)
    for c, turns in convs.items():
        known = []
        for p, t in enumerate(turns):
            back = h(0, c, t) % 5
            start = 7 * p
            if back and back <= p:
                status, _, _, last = known[p - back]
                if status != "delivered":
                    known.append(("blocked", 0, None, None))
                    continue
                start = max(start, last)
            repaired = 7 * p + h(2, c, t) % 101 if h(1, c, t) % 101 < 50 else None
            times = [start + 10 * (2**a - 1) for a in range(6)]
            won = next((a for a, at in enumerate(times) if repaired is None or (at >= repaired and h(a + 3, c, t) % 3)), None)
            known.append(("dead", 6, start, times[5]) if won is None else ("delivered", won + 1, start, times[won]))
        state, n = 0, 0
        order = sorted((k[3], t) for k, t in zip(known, turns, strict=True) if k[0] == "delivered")
        told = {}
        for _, t in order:
            n += 1
            state += n * texts[c, t]
            told[t] = n, state
        for k, t in zip(known, turns, strict=True):
            out[c, t] = (*k, *told.get(t, (None, None)))
    return out


NAMES = ["status", "attempts", "first_at", "last_at", "release_no", "state"]


def told(df):
    return {(r["conv_id"], r["turn"]): tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_replay(spark, threshold):
    rng = random.Random(4)
    rows = [(c, 3 * t - 50, f"text {rng.random()}") for c in range(40) for t in range(rng.randint(1, 30))]
    rows += [(-7, t, "x" * (t % 5)) for t in range(2500)] + [(99, 1 << 40, "far"), (99, -5, None), (99, 0, ""), (99, 0, ""), (99, 7, "b"), (99, 7, "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows] + [(None, 1, "x", ""), (5, None, "y", ""), (5, None, "z", "")], "conv_id long, turn long, text string, piece string").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = told(release.replay(df, piece=16))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = by_hand(rows)
    lost = {k: got.pop(k) for k in ((None, 1), (5, None))}
    assert set(lost.values()) == {(None,) * 6}
    assert got == want
    assert {s[0] for s in want.values()} == {"delivered", "dead", "blocked"}


def test_replay_of_nothing_and_of_bad_laws(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, text string")
    assert release.replay(none).count() == 0
    with pytest.raises(ValueError):
        release.replay(none, release.Law(interval=0))


def test_feed_holds_the_texts_in_order(spark):
    rows = [(1, t, f"t{t}") for t in range(50)] + [(1, 3, "t3"), (2, 0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    want = {k: v for k, v in by_hand(rows).items() if v[0] == "delivered"}
    got = release.feed(df).collect()
    assert {(r["conv_id"], r["turn"]): (r["released_at"], r["release_no"], r["state"]) for r in got} == {k: v[3:] for k, v in want.items()}
    assert all(r["text"] == ("" if r["conv_id"] == 2 else f"t{r['turn']}") for r in got)


def test_state_wraps(spark):
    rows = [(str(v),) for v in [0, (1 << 63) - 1, 1 << 63, (1 << 64) + 5, -(1 << 63), 10**30]]
    df = spark.createDataFrame(rows, "s string").select("s", release._wrapped(F.col("s").cast("decimal(38,0)")).alias("x"))
    for s, x in df.collect():
        assert x == (int(s) + (1 << 63)) % (1 << 64) - (1 << 63)


def test_prefix_sums_by_level(spark):
    rng = random.Random(2)
    rows = [(k, a, rng.randint(0, 9)) for k in range(3) for a in rng.sample(range(-(1 << 40), 1 << 40), 300)] + [(9, a, 1) for a in range(1000)]
    got = {(r["k"], r["a"]): r["before_v"] for r in release.before(spark.createDataFrame(rows, "k int, a long, v long"), "k", "a", ["v"]).collect()}
    sums = defaultdict(int)
    for k, a, v in sorted(rows):
        assert got[k, a] == sums[k]
        sums[k] += v


def brute_codes(rows, parts, entries, rounds):
    x = {i: np.floor(np.array(v, float) * 1024).astype(np.int64) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    ids = sorted(x)
    books = [[x[i].reshape(parts, -1)[p] for i in ids[:entries]] for p in range(parts)]

    def near(v, book):
        return min((int(((v - e) ** 2).sum()), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for i in ids:
                own[near(x[i].reshape(parts, -1)[p], books[p])[1]].append(x[i].reshape(parts, -1)[p])
            for k, vs in own.items():
                books[p][k] = np.array([int(sum(int(v[j]) for v in vs) // len(vs)) for j in range(len(vs[0]))])
    out = {}
    for i in ids:
        found = [near(x[i].reshape(parts, -1)[p], books[p]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
    return out, books


def embedded(seed=1, n=300):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 8))
    rows = [(i, (centres[i % 9] + rng.normal(size=8) * 0.1 * (i % 3)).tolist(), None if i % 5 == 0 else i % 2) for i in range(n)]
    return [*rows, (n, None, 1), (n + 1, [1.0] * 7 + [float("nan")], 0), (n + 2, [float("inf")] + [0.0] * 7, 0), (n + 3, [None] + [0.0] * 7, 0)]


def test_codes(spark):
    rows = embedded()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, error string").repartition(4)
    want, books = brute_codes(rows, 4, 20, 3)
    got = codes.report(df, 4, 20, 3).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    labels = {i: label for i, _, label in rows}
    sums = defaultdict(int)
    for i, (_, e) in want.items():
        sums[labels[i]] += e
    assert all(r["label_error"] == sums[labels[r["vec_id"]]] for r in got)
    coded, found = codes.compress(df, 4, 20, 3)
    assert all((np.array(a) == np.array(b)).all() for a, b in zip(found, books, strict=True))
    back = {r["vec_id"]: np.array(r["v"]) * 1024 for r in codes.restored(coded, found).collect()}
    x = {i: np.floor(np.array(v) * 1024) for i, v, _ in rows[:300]}
    assert all(((back[i] - x[i]) ** 2).sum() == want[i][1] for i in want)


def test_codes_of_few_repeated_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([(1, None, 1)], kind)
    assert codes.report(none).count() == 0
    same = spark.createDataFrame([(7, [0.5, -0.5, 1.0, 2.0], None)] * 3 + [(None, [0.0] * 4, None)], kind)
    got = codes.report(same, rounds=2).collect()
    assert [r["error"] for r in got] == [0] * 4 and sorted(r["code"] for r in got) == ["00000000"] * 3 + ["03030303"] and {r["label_error"] for r in got} == {0}
    for bad in ([(1, [0.0] * 4, 0), (2, [0.0] * 8, 0)], [(1, [0.0] * 3, 0)], [(1, [1e9] * 4, 0)]):
        with pytest.raises(ValueError):
            codes.report(spark.createDataFrame(bad, kind))


def test_tree_finds_what_a_scan_finds_and_passes_over_branches():
    rng = np.random.default_rng(5)
    for width, spread in ((1, 3), (2, 5), (16, 4), (16, 500), (3, 10**6)):
        entries = rng.integers(-spread, spread, size=(256, width))
        rows = np.concatenate([rng.integers(-spread, spread, size=(400, width)), entries[:50]])
        tree = codes.VantageTree(entries)
        index, best = tree.nearest(rows)
        d = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        if width <= 3 and spread > 100:
            assert tree.visited < 0.5 * len(rows) * 256
    assert codes.VantageTree(np.zeros((40, 2))).nearest(np.zeros((3, 2)))[0].tolist() == [0, 0, 0]
    assert len(codes.VantageTree(np.zeros((0, 2))).nearest(np.zeros((0, 2)))[0]) == 0


def test_registered(spark):
    assert {"op11_release", "op12_vector_fit", "op13_vector_codes"} <= set(queries.queries())
