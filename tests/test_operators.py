import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmatch.functions import similarity
from quillmatch.operators import evaluate, logistic, models, relational, stats, vectors


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, None)], "id int, k string, e string")
    assert relational.drop_all_null(df).columns == ["id", "k"]
    assert {tuple(r) for r in relational.keep_first(df.select("id", "k"), ["k"], ["id"]).collect()} == {(1, "a"), (3, None)}
    assert rows(relational.mark_duplicates(df.select("id", "k"), ["k"]).select("id", "is_duplicate")) == [(1, True), (2, True), (3, False)]
    assert relational.without(df, F.col("k") == "a").count() == 1
    assert relational.suffixed(df, "_1", ("id",)).columns == ["id", "k_1", "e_1"]
    assert relational.clean_names(spark.createDataFrame([(1,)], "`/a.b/` int")).columns == ["a_b"]
    wanted = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    for limit in (0, 10):
        assert [r["id"] for r in relational.semi_join(df, wanted, "id", limit).collect()] == [1]
    assert rows(relational.blocked_pairs(df.select("id", "k"), "id", ["k"])) == [(1, 2)]
    u = relational.union_all(df.select("id"), df.select("k"))
    assert u.count() == 6 and u.filter("id IS NULL").count() == 3
    long = relational.melt(df, ["id"], ["k", "e"])
    assert long.count() == 6 and long.filter("value IS NULL").count() == 4
    assert relational.sample_rows(df, ["id"], 2, 1).collect() == relational.sample_rows(df, ["id"], 2, 1).collect()
    assert relational.sort_columns(df, "id").columns == ["id", "e", "k"]


def test_profiles(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, 4.0, None), (300, 6.5, None)], "a int, b double, c string")
    assert dict(rows(stats.percent_nulls(df))) == pytest.approx({"a": 0, "b": 0, "c": 200 / 3})
    assert [(r["column"], r["kind"]) for r in stats.narrow_types(df, ["a", "b"]).collect()] == [("a", "uint16"), ("b", "double")]
    assert dict(stats.narrowed(df, ["a", "b"]).dtypes)["a"] == "int"
    small = spark.createDataFrame([(254, -1), (0, 5)], "u int, s int")
    assert [r["kind"] for r in stats.narrow_types(small, ["u", "s"]).collect()] == ["uint8", "int8"]
    assert [r["kind"] for r in stats.narrow_types(spark.createDataFrame([(255,), (0,)], "u int"), ["u"]).collect()] == ["uint16"]
    assert stats.correlations(df, ["a", "b"]).first()["value"] == pytest.approx(np.corrcoef([1, 2, 300], [2, 4, 6.5])[0, 1])
    assert stats.five_numbers(df, "b", []).first()["median"] == 4.0
    zeros = spark.createDataFrame([(0, None), (1, 0)], "a int, b int").select(stats.count_zeros(["a", "b"])).collect()
    assert [r[0] for r in zeros] == [1, 1]
    empty = df.limit(0)
    assert all(r["percent_null"] is None for r in stats.percent_nulls(empty).collect())
    assert stats.value_counts(df, "c").collect()[0]["n"] == 1


def test_tfidf_has_length_one_and_cosine_of_itself(spark):
    docs = spark.createDataFrame([(1, "red cat sat"), (2, "red dog"), (3, None), (4, "red cat sat")], "id int, t string")
    w = vectors.tfidf(docs, "id", "t", 1, 2)
    assert all(r[1] == pytest.approx(1) for r in w.groupBy("id").agg(F.sum(F.col("w") * F.col("w"))).collect())
    pairs = spark.createDataFrame([(1, 4), (1, 3), (1, 2)], "a int, b int")
    got = {(r["a"], r["b"]): r["cosine"] for r in vectors.pair_cosines(pairs, w, ["a"], ["b"], ["id"]).collect()}
    assert got[1, 4] == pytest.approx(1) and got[1, 3] == 0 and 0 < got[1, 2] < 1
    by = vectors.tfidf(docs.withColumn("g", F.col("id") % 2), "id", "t", 1, 1, groups=("g",))
    assert by.select("g").distinct().count() == 2


def test_svd_keeps_inner_products(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3}x w{i % 5}y common") for i in range(12)], "id int, t string")
    w = vectors.tfidf(docs, "id", "t", 1, 1)
    v, ratios = vectors.truncated_svd(w, "id", components=9)
    got = {r["id"]: r["v"] for r in v.collect()}
    assert sum(a * b for a, b in zip(got[0], got[0], strict=True)) == pytest.approx(1)
    exact = vectors.pair_cosines(spark.createDataFrame([(0, 3)], "a int, b int"), w, ["a"], ["b"], ["id"]).first()["cosine"]
    assert sum(a * b for a, b in zip(got[0], got[3], strict=True)) == pytest.approx(exact)
    assert sum(ratios) == pytest.approx(1)
    assert vectors.components_to_keep([0.5, 0.4, 0.0995, 0.0005]) == 2


@pytest.mark.parametrize("held", [vectors.HELD, 0])
def test_svd_takes_every_term_and_document(spark, held, monkeypatch):
    monkeypatch.setattr(vectors, "HELD", held)
    monkeypatch.setattr(vectors, "POSTINGS", 100)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = random.Random(4)
    texts = [" ".join(f"t{min(int(rng.expovariate(0.01)), 5999)}x{rng.randint(0, 40)}" for _ in range(60)) + " all" for _ in range(150)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    w = vectors.tfidf(docs, "id", "t", 1, 1)
    at = {r: i for i, r in enumerate(sorted({r["term"] for r in w.collect()}))}
    assert len(at) > 4096
    m = np.zeros((151, len(at)))
    for r in w.collect():
        m[r["id"], at[r["term"]]] = r["w"]
    v, ratios = vectors.truncated_svd(w, "id", components=150, keys=docs)
    got = {r["id"]: r["v"] for r in v.collect()}
    assert len(got) == 151 and not any(got[150])
    x = np.array([got[i] for i in range(151)])
    assert np.allclose(x @ x.T, m @ m.T) and sum(ratios) == pytest.approx(1)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert ratios[:5] == pytest.approx(((u[:, :5] * s[:5]).var(0) / m.var(0).sum()).tolist())


@pytest.mark.parametrize("ranked", [stats.RANKED, 3])
def test_quantiles_are_exact(spark, ranked):
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1e6), 7.0, -1e-9 * rng.random(), None])) for _ in range(400)] + [("c", None), ("d", 5.0), ("e", float("nan"))]
    df = spark.createDataFrame(data, "g string, x double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in stats.quantiles(df, "x", ["g"], shares, ranked).collect()}
    assert set(got) == {"a", "b", None, "c", "d", "e"} and got["c"] == got["e"] == [None] * 5 and got["d"] == [5.0] * 5
    for g in ("a", "b", None):
        xs = [x for h, x in data if h == g and x is not None]
        assert got[g] == pytest.approx(np.quantile(xs, shares).tolist(), rel=1e-12, abs=1e-15)
    assert stats.quantiles(df, "x", [], [0.5]).count() == 1
    assert stats.quantiles(df.limit(0), "x", ["g"], [0.5]).count() == 0
    five = {r["g"]: r["median"] for r in stats.five_numbers(df, "x", ["g"]).collect()}
    assert five["d"] == 5.0 and five["c"] is None and len(five) == 6


def test_bits_are_in_the_order_of_doubles(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64).view(np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    x = np.concatenate([x[np.isfinite(x)], powers, np.nextafter(powers, np.inf), np.nextafter(powers, 0), [0.0, np.inf], rng.normal(size=1000) ** 2])
    x = np.concatenate([x, -x])
    got = np.array([r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(stats.order_bits(F.col("x"))).collect()])
    size = np.abs(x).view(np.int64)
    assert (got == np.where(x < 0, -size, size)).all()


@pytest.mark.parametrize("ranked", [stats.RANKED, 3])
def test_quantiles_of_infinities(spark, ranked):
    inf = float("inf")
    sets = {"up": [1.0, 2.0] + [inf] * 8, "two": [-inf] * 3 + [inf] * 3, "low": [-inf] * 5 + [4.0] * 4, "mid": [-inf, 1.0, 5e-324, 0.0, -0.0, 1e308, inf], "wide": [-1.7e308, 1.7e308]}
    df = spark.createDataFrame([(g, x) for g, xs in sets.items() for x in xs], "g string, x double")
    got = {r["g"]: r["q"] for r in stats.quantiles(df, "x", ["g"], [0.0, 0.15, 0.5, 1.0], ranked).collect()}
    assert got["up"][0] == 1.0 and got["up"][1] == inf and got["up"][2:] == [inf, inf]
    assert got["two"][0] == -inf and math.isnan(got["two"][2]) and got["two"][3] == inf
    assert got["low"] == [-inf, -inf, -inf, 4.0]
    assert got["mid"][2] == 5e-324 and got["mid"][3] == inf and got["mid"][1] == -inf
    assert got["wide"][2] == 0.0


def test_quantiles_of_many_groups(spark, monkeypatch):
    """More groups than are broadcast: ranges are joined by shuffle, and a large group is dealt to copies."""
    monkeypatch.setattr(stats, "BROADCAST_RANGES", 100)
    df = spark.range(60_000).select(F.when(F.col("id") < 20_000, F.lit(-1)).otherwise(F.floor(F.col("id") / 2)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("x"))
    got = {r["g"]: r["q"] for r in stats.quantiles(df, "x", ["g"], [0.5], 500).collect()}
    mine: dict = {}
    for g, x in df.collect():
        mine.setdefault(g, []).append(x)
    assert len(got) == 20_001 and all(got[g] == [np.median(xs)] for g, xs in mine.items())


def test_description_of_all_columns(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (2, "b", None), (3, "a", None)], "i int, s string, n string")
    got = {r["column"]: tuple(r)[1:] for r in stats.described(df, ["i", "s", "n"]).collect()}
    assert got == {"i": (4, 3, "2", 2, "1", "3"), "s": (4, 2, "a", 2, "a", "b"), "n": (0, 0, None, None, None, None)}


def test_numbers_marks_and_joins_without_a_hot_task(spark):
    rng = random.Random(2)
    data = [(rng.choice(["x", "x", "x", "y", None]), rng.randrange(50), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    got = {r["i"]: r["n"] for r in relational.numbered(df, ["g"], "v", ["i"], buckets=7).collect()}
    for g in ("x", "y", None):
        assert [got[i] for _, _, i in sorted((t for t in data if t[0] == g), key=lambda t: t[1:])] == list(range(1, sum(t[0] == g for t in data) + 1))
    assert relational.numbered(df.limit(0), ["g"], "v").count() == 0
    for few in (0, 100):
        marked = relational.mark_duplicates(df, ["g", "v"], broadcast_rows=few).collect()
        assert all(r["is_duplicate"] == (sum(t[:2] == (r["g"], r["v"]) for t in data) > 1) for r in marked) and len(marked) == 200
    a, b = spark.createDataFrame([(1, None), (1, None), (2, None)], "k int, e string"), spark.createDataFrame([(1, "p"), (3, "q")], "k int, w string")
    assert [tuple(r) for r in relational.join_complete(a, b, "k").collect()] == [(1, "p")]
    assert relational.digest(["a"], 3) is not None
    assert [r["i"] for r in relational.keep_first(df.filter("g = 'y'"), ["g"], ["v", "i"]).collect()] == [min((t[1], t[2]) for t in data if t[0] == "y")[1]]


def test_refined_grids_and_points():
    assert models.finer(3.0) == [1.0, 2.0, 3.0, 6.0, 9.0]
    assert {k: models.grid_size(g, models.FOLDS[k]) for k, g in models.GRIDS.items()} == {"svc": 16, "rf": 32, "gbt": 64, "rf fine": 192, "gbt fine": 4608}
    assert len(models.spark_points(models.GRIDS["rf"])) == 16 and len(models.spark_points(models.GRIDS["gbt"])) == 32
    # leaves, warm starts and splits below two leaves are one to Spark
    assert len(models.spark_points(models.GRIDS["gbt fine"])) == 2 * 2 * 2 * 2 * 3 * 3 * 2
    assert models.spark_params({"depth": None, "features": None, "split": 4, "trees": 500}, 0.1) == {"maxDepth": 30, "featureSubsetStrategy": "all", "minInstancesPerNode": 2, "numTrees": 50}


def test_columns_that_tell_nothing_go(spark):
    rng = random.Random(5)
    rows = [(x := rng.gauss(0, 1), x * 2 + rng.gauss(0, 0.01), y := rng.gauss(0, 1), x + y, 1.0, 0.0 if i else 1.0, 0.0 if i < 290 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, one double, nearly double, many double")
    assert models.near_zero_variance(df, df.columns) == ["one", "nearly", "many"]
    left = models.informative(df, df.columns)
    assert len({"a", "b"} & set(left)) == 1 and {"c"} <= set(left) and not {"one", "nearly"} & set(left)


def test_stepwise_equals_single_fits(spark):
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = random.Random(6)
    data = []
    for _ in range(300):
        x = [rng.gauss(0, 1) for _ in range(4)]
        data.append((*x, int(x[0] - 0.8 * x[2] + rng.gauss(0, 1) > 0)))
    df = spark.createDataFrame(data, "a double, b double, c double, d double, label int")
    left, value = models.stepwise_glm(df, ["a", "b", "c", "d"])
    one = lambda cols: GeneralizedLinearRegression(family="binomial", labelCol="label").fit(models.assembled(df, list(cols))).summary.deviance + math.log(300) * (len(cols) + 1)
    best = ["a", "b", "c", "d"]
    while len(best) > 1 and min(one([c for c in best if c != x]) for x in best) < one(best):
        best.remove(min(best, key=lambda x: one([c for c in best if c != x])))
    assert left == best and value == pytest.approx(one(best), rel=1e-6)


def test_searches(spark):
    rng = random.Random(7)
    data = [(i, i % 2, rng.gauss(i % 2 * 3, 1), rng.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id long, label int, a double, b double")
    model, mix, penalty = models.elastic_net(df, ["a", "b"], mixes=[1.0, 10.0], penalties=[0.01, 1.0], folds=2, repeats=2)
    assert mix == 1.0 and penalty in (0.01, 1.0)
    assert evaluate.scores(model.transform(models.assembled(df, ["a", "b"]))).first()["f1"] > 0.85
    told = {r["feature"]: r for r in models.coefficients(spark, model, ["a", "b"]).collect()}
    assert set(told) == {"a", "b"} and told["a"]["importance"] == abs(told["a"]["coefficient"]) > told["b"]["importance"]
    dealt = models.stratified_folds(models.with_weights(df), "label", "vec_id", 2)
    gamma, found = models.kernel_search(dealt, ["a", "b"], {"C": [1.0], "gamma": [0.1, 1.0]}, components=8)
    assert gamma in (0.1, 1.0) and len(found.avgMetrics) == 1


def brute(pairs):
    tp = sum(y == p == 1 for y, p in pairs)
    fp, fn = sum((y, p) == (0, 1) for y, p in pairs), sum((y, p) == (1, 0) for y, p in pairs)
    return tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0


def test_evaluation_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(60)]
    df = spark.createDataFrame([(y, s, int(s > 0.5)) for y, s in data], "label int, score double, prediction int")
    p, r = brute([(y, int(s > 0.5)) for y, s in data])
    got = evaluate.scores(df).first()
    assert (got["precision"], got["recall"]) == pytest.approx((p, r))
    curve = {c["threshold"]: (c["precision"], c["recall"]) for c in evaluate.pr_curve(df, buckets=3).collect()}
    for t in {s for _, s in data}:
        assert curve[t] == pytest.approx(brute([(y, int(s >= t)) for y, s in data]))
    ordered = [curve[t][1] for t in sorted(curve)]
    assert ordered == sorted(ordered, reverse=True)
    area, last = 0.0, (1.0, 0.0)
    for t in sorted(curve, reverse=True):
        area += (curve[t][1] - last[1]) * (curve[t][0] + last[0]) / 2
        last = curve[t]
    assert evaluate.pr_area(evaluate.pr_curve(df)).first()["auc"] == pytest.approx(area)
    picks = {x["pick"]: x["threshold"] for x in evaluate.threshold_picks(evaluate.pr_curve(df)).collect()}
    assert picks["recall_1"] == min(t for t in curve if curve[t][1] == 1)
    none = spark.createDataFrame([(0, 0)], "label int, prediction int")
    assert tuple(evaluate.scores(none).first()) == (0, 0, 0)
    assert evaluate.pr_curve(df.limit(0)).count() == 0
    assert {x["class"] for x in evaluate.report(df).collect()} == {"0", "1", "macro avg", "weighted avg"}


def test_scaling_folds_weights(spark):
    df = spark.createDataFrame([(i, i % 4 == 0, float(i)) for i in range(40)], "id int, y boolean, x double").withColumn("label", F.col("y").cast("int"))
    z = models.standard_scale(df, ["x"]).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    counts = models.stratified_folds(df, "label", "id", 3).groupBy("label", "fold").count().collect()
    by = {(r["label"], r["fold"]): r["count"] for r in counts}
    assert all(max(v) - min(v) <= 1 for v in ([by[y, f] for f in range(3)] for y in (0, 1)))
    assert dict(rows(models.class_weights(df))) == pytest.approx({0: 40 / 60, 1: 40 / 20})
    a, b = models.random_split(df, "id", 70, 1)
    assert a.count() + b.count() == 40 and a.count() > b.count()
    assert models.grid_size({"a": [1, 2], "b": [1, 2, 3]}, 2) == 12
    assert models.informative(df.withColumn("c", F.lit(1.0)).withColumn("d", F.col("x") * 2), ["x", "c", "d"]) == ["x"]


def test_models_learn(spark):
    rng = random.Random(1)
    data = [(i, i % 2, rng.gauss(i % 2 * 4, 1), rng.gauss(0, 1)) for i in range(200)]
    df = models.with_weights(models.assembled(spark.createDataFrame(data, "id int, label int, a double, b double"), ["a", "b"]))
    for name in ("nb", "rf"):
        out = models.fit_predict(df, df, models.classifiers()[name])
        assert evaluate.scores(out).first()["f1"] > 0.9
    rf = models.classifiers()["rf"].fit(df)
    assert models.importances(rf, ["a", "b"])[0][0] == "a"
    left, _ = models.stepwise_glm(df, ["a", "b"])
    assert "a" in left
    assert math.isclose(models.inflation_factors(df, ["a", "b"])["a"], 1, abs_tol=0.2)
    circle = [(i, int(x * x + y * y < 1), x, y) for i, (x, y) in enumerate((rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(400))]
    c = models.with_weights(models.fourier_features(spark.createDataFrame(circle, "id int, label int, a double, b double"), ["a", "b"], gamma=1.0))
    assert evaluate.scores(models.fit_predict(c, c, models.classifiers()["svc"])).first()["f1"] > 0.8


def test_terms_are_numbers_with_a_dictionary(spark):
    docs = spark.createDataFrame([(1, "red cat sat on red cat"), (2, "red"), (3, None), (4, "")], "id int, t string")
    known = {r["term"]: r["words"] for r in vectors.dictionary(docs, "t", 1, 3).collect() if not r["shared"]}
    assert sorted(known.values()) == sorted({"red", "cat", "sat", "on", "red cat", "cat sat", "sat on", "on red", "red cat sat", "cat sat on", "sat on red", "on red cat"})
    tf = {(r["id"], known[r["term"]]): r["tf"] for r in vectors.term_counts(docs, "id", "t", 1, 3).collect()}
    assert tf[1, "red cat"] == 2 and tf[2, "red"] == 1 and len(tf) == 13
    df = {known[r["term"]]: r["df"] for r in vectors.document_frequencies(docs, "t", 2, 3).collect()}
    assert set(df.values()) == {1} and "red" not in df and len(df) == 8


def test_svd_holds_few_columns_of_many_documents(spark, monkeypatch):
    """Tasks hold some columns of the subspace, no vector of a document whole, and the result is the same."""
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(r.expovariate(0.05))}" for _ in range(20))) for i in range(90)], "id int, t string")
    w = vectors.tfidf(docs, "id", "t", 1, 1)
    cuts, turn = [], vectors._turn
    monkeypatch.setattr(vectors, "_turn", lambda *a: cuts.append(len(a[5])) or turn(*a))

    def products():
        v, ratios = vectors.truncated_svd(w, "id", components=6, keys=docs, iterations=30)
        x = np.array([r["v"] for r in v.orderBy("id").collect()])
        return x @ x.T, ratios

    whole = products()
    assert set(cuts) == {16}
    monkeypatch.setattr(vectors, "HELD", 90 * 8 * 5)
    cuts.clear()
    some = products()
    assert max(cuts) <= 5 and np.allclose(whole[0], some[0], atol=1e-6) and some[1] == pytest.approx(whole[1], abs=1e-6)


def test_terms_of_documents_are_counted_where_texts_lie(spark, monkeypatch):
    """The numbers are Spark's of gram_ids, for words of any length and script; no n-gram is shuffled or sorted by Spark."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcé日ß_0-. İΣ") for _ in range(r.choice([1, 2, 3, 5, 8, 13, 33, 70, 200])))
    rows = [(i, i % 3, " ".join(word() for _ in range(r.randrange(40)))) for i in range(60)] + [(60, 0, None), (61, 1, ""), (62, 2, "one"), (63, None, "two words")]
    docs = spark.createDataFrame(rows, "id int, g int, t string").repartition(3)
    monkeypatch.setattr(vectors, "TEXT", 300)
    monkeypatch.setattr(vectors, "COUNTED", 100)
    for low, high in ((1, 1), (1, 3), (2, 3)):
        words = docs.select("id", "g", vectors.pinned(vectors.tokens(F.col("t"))).alias("ws"))
        plain = words.select("id", "g", F.explode(vectors.gram_ids(F.col("ws"), low, high)).alias("term")).groupBy("id", "g", "term").agg(F.count("*").alias("tf"))
        assert sorted(map(tuple, vectors.term_counts(docs, "id", "t", low, high).collect())) == sorted((x.id, x.term, x.tf) for x in plain.collect())
        by = {(x.g, x.term): x.df for x in vectors.document_frequencies(docs, "t", low, high, ("g",)).collect()}
        assert by == {(x.g, x.term): x.n for x in plain.groupBy("g", "term").agg(F.count("*").alias("n")).collect()}
    plan = vectors.tfidf(docs, "id", "t", 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0] and "Sort" not in plan


def test_texts_of_one_key_are_one_document(spark):
    docs = spark.createDataFrame([(1, "red cat"), (1, "red"), (2, "cat")], "id int, t string")
    w = {(x.id, x.term): x.w for x in vectors.tfidf(docs, "id", "t", 1, 1).collect()}
    assert len(w) == 3 and sorted(w.values())[-1] == pytest.approx(1) and sum(v * v for (i, _), v in w.items() if i == 1) == pytest.approx(1)


def test_frequent_terms_are_split(spark, monkeypatch):
    """Zipf's words, more than are broadcast: the weights are those of the broadcast table, and no task holds a frequent word's rows."""
    rng = random.Random(6)
    texts = [(i, "the " + " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(20))) for i in range(600)]
    docs = spark.createDataFrame(texts, "id int, t string").repartition(8)
    key = lambda df: {(r["id"], r["term"]): round(r["w"], 12) for r in df.collect()}
    whole = key(vectors.tfidf(docs, "id", "t", 1, 1))
    monkeypatch.setattr(vectors, "BROADCAST_TERMS", 50)
    monkeypatch.setattr(vectors, "HOT", 30)
    split = vectors.tfidf(docs, "id", "t", 1, 1)
    assert key(split) == whole
    monkeypatch.setattr(vectors, "HOT", 2)  # even the frequent ones are many: they are salted
    assert key(vectors.tfidf(docs, "id", "t", 1, 1)) == whole


def fold_rows(spark, n=400, d=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 3, 0.1, 1, 0] + [0, 5, 0, 0, 2]
    y = (x @ [1.0, -0.4, 3.0, 0, 0] + 2 + rng.logistic(size=n) > 0).astype(int)
    rows = [(i, *map(float, r), int(t), 1.0 + i % 3) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    names = [f"c{j}" for j in range(d)]
    return spark.createDataFrame(rows, "vec_id long, " + ", ".join(f"{c} double" for c in names) + ", label int, weight double").repartition(5, "vec_id"), names


def test_penalised_fits_are_sparks(spark):
    from pyspark.ml.classification import LogisticRegression

    df, names = fold_rows(spark)
    rows = df.select(F.array(*names).alias("x"), F.col("label").cast("double").alias("y"), F.col("weight").alias("w"), F.array((F.col("vec_id") % 4).cast("int")).alias("folds"))
    points = [logistic.Point(m, p, 0, f) for m, p, f in ((0.0, 0.1, None), (1.0, 0.05, None), (0.5, 0.001, 2), (0.3, 0.3, 0), (1.0, 10.0, None))]
    beta = logistic.fits(rows, points)
    v = models.assembled(df, names)
    for b, p in zip(beta, points, strict=True):
        seen = v if p.fold is None else v.filter(F.col("vec_id") % 4 != p.fold)
        theirs = LogisticRegression(elasticNetParam=p.mix, regParam=p.penalty, maxIter=500, tol=1e-12, weightCol="weight").fit(seen)
        assert b[0] == pytest.approx(theirs.intercept, abs=1e-4) and b[1:] == pytest.approx(theirs.coefficients.toArray(), abs=1e-4), p
    right = logistic.held_out_accuracy(rows, points[2:4], beta[2:4])
    for r, p, b in zip(right, points[2:4], beta[2:4], strict=True):
        own = [(row["x"], row["y"]) for row in rows.collect() if row["folds"][0] == p.fold]
        assert r == pytest.approx(np.mean([(np.dot(x, b[1:]) + b[0] > 0) == (y > 0.5) for x, y in own]))


def test_sums_reach_the_driver_once_a_model(spark):
    """Whatever the number of tasks: what is collected is a row a model."""
    rows = spark.range(0, 1000, 1, 50).select((F.col("id") % 3).alias("model"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("sums"))
    got = logistic.summed(rows)
    assert {m: v.tolist() for m, v in got.items()} == {m: [len(range(m, 1000, 3)), sum(range(m, 1000, 3))] for m in range(3)}


def test_elastic_net_takes_the_point_that_does_best(spark):
    df, names = fold_rows(spark, 300)
    model, mix, penalty = models.elastic_net(df, names, mixes=[0.0, 1.0, 7.0], penalties=[0.01, 100.0], folds=3, repeats=2)
    assert penalty == 0.01 and mix in (0.0, 1.0) and model.getRegParam() == 0.01


def test_boosting_stops_with_patience(spark):
    assert models.stopping_round([5, 4, 3, 3, 3, 3], 2, 0.1) == 5 and models.stopping_round([3, 2, 1], 5) == 3 and models.stopping_round([1, 2, 3], 1) == 2
    df, names = fold_rows(spark, 300)
    v = models.assembled(df, names)
    train, watch = models.random_split(v, "vec_id", 70, 1)
    whole = models.GBTClassifier(maxIter=12, maxDepth=2, seed=0).fit(train)
    losses = whole.evaluateEachIteration(watch)
    model = models.boosted_with_stop(train, watch, 12, patience=2, tolerance=0.01, maxDepth=2)
    n = models.stopping_round(losses, 2, 0.01)
    assert model.getNumTrees == n < 12 and model.numFeatures == len(names)
    assert model.evaluateEachIteration(watch) == pytest.approx(losses[:n])
    assert model.transform(watch).select("prediction").count() == watch.count() and models.importances(model, names)


def test_dev_rows_are_scored_before_the_refit(spark):
    df, names = fold_rows(spark, 300)
    v = models.assembled(df, names).select("vec_id", "label", "features")
    train, test = models.random_split(v, "vec_id", 70, 1)
    train, dev = models.random_split(train, "vec_id", 80, 2)
    made, told = models.search_refit_predict(train, test, {"nb": [], "rf": [{"numTrees": 3, "maxDepth": d} for d in (1, 4)]}, "vec_id", dev=dev)
    counts = {(r["model"], r["part"]): r["count"] for r in told.groupBy("model", "part").count().collect()}
    assert counts == {(m, p): n for m in ("nb", "rf") for p, n in (("dev", dev.count()), ("test", test.count()))}
    both = models.with_weights(train.unionByName(dev))
    again = models.classifiers()["nb"].fit(both).transform(test)
    assert sorted(map(tuple, again.select("vec_id", "prediction").collect())) == sorted(map(tuple, told.filter("model = 'nb' AND part = 'test'").select("vec_id", "prediction").collect()))


def test_tiled_pairs_are_all_pairs_in_many_tasks(spark):
    rows = [(i, "a" if i % 3 else "b", None if i % 7 == 0 else f"n{i % 5}") for i in range(60)] + [(60, None, "x"), (61, None, "x")]
    df = spark.createDataFrame(rows, "id int, block string, name string").coalesce(1)
    expected = sorted((a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and a[0] < b[0])
    for tile in (4096, 7):
        pairs = relational.tiled_pairs(df, "id", ["block"], tile=tile, candidates=100)
        assert sorted((r.id_1, r.id_2) for r in pairs.collect()) == expected
        assert pairs.rdd.getNumPartitions() > 4
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    for values in (1000, 3):
        told = relational.tiled_pairs_with(df, "id", ["block"], "name", same, "same", values)
        assert sorted((r.id_1, r.id_2, r.same) for r in told.collect()) == [(a, b, rows[a][2] is not None and rows[a][2] == rows[b][2]) for a, b in expected]


def test_rounded_is_round(spark):
    values = [None, float("nan"), float("inf"), 0.0, -1e-9, 1.0000005, 0.1234565, 2.5e-7, 5e-7, 1.5e-6, 1.7976931348623157e308, -0.1234565, 1e13 + 0.1, *[i / 7919 for i in range(-500, 500)]]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(similarity.rounded(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b"))
    assert df.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_near_cosines_are_pair_cosines(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choice("ab cd ef gh ij kl mn op".split()) for _ in range(r.randrange(9)))) for i in range(40)], "id int, t string")
    pairs = spark.createDataFrame([(i, j, None if i == 5 else i % 3) for i in range(40) for j in range(i + 1, 44) if (i + j) % 2], "a int, b int, block int")
    weights = vectors.tfidf(docs, "id", "t", 1, 2)
    expected = {(x.a, x.b): x.cosine for x in vectors.pair_cosines(pairs, weights, ["a"], ["b"], ["id"]).collect()}
    own = {x.id for x in weights.select("id").distinct().collect()}
    for tile in (512, 4):
        near = vectors.near_cosines(pairs, vectors.weight_lists(weights, ["id"]), ["a"], ["b"], ["id"], ["block"], tile)
        got = near.collect()
        assert len(got) == pairs.count() and all(abs(x.cosine - expected[x.a, x.b]) < 1e-9 and (x.has_1, x.has_2) == (x.a in own, x.b in own) for x in got)


def test_fits_read_few_parts_and_cosines_are_those_of_the_formula(spark, monkeypatch):
    df, names = fold_rows(spark, 200)
    v = models.stratified_folds(models.fourier_features(df, names, 0.5, 16), "label", "vec_id", 2).repartition(64)
    parts, fit = [], models.CrossValidator.fit
    monkeypatch.setattr(models.CrossValidator, "fit", lambda self, rows: parts.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    assert len(models.grid_search(v, models.LinearSVC(maxIter=3), [{"regParam": 0.1}, {"regParam": 1.0}]).avgMetrics) == 2
    assert parts == [1]
    rng = np.random.default_rng(11)
    w, b = rng.normal(0, 1.0, (16, len(names))), rng.uniform(0, 2 * np.pi, 16)
    for r in v.limit(9).collect():
        expected = [sum(u * r[c] for u, c in zip(row, names, strict=True)) + o for row, o in zip(w, b, strict=True)]
        assert np.allclose(r["features"].toArray(), np.cos(expected) * (2 / 16) ** 0.5)
