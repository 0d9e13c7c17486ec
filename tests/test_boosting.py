import numpy as np
import pytest

from quillmatch.operators import boosting, models
from quillmatch.operators.boosting import Booster


def table(spark, n=300, seed=4, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    x[rng.random((n, 3)) < 0.05] = np.nan
    y = (np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]) + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], int(y[i]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int, fold int").repartition(parts), x, y


def plain(bins, y, m, rounds):
    """Margins of a booster that looks at one leaf after the other and splits the best of all."""
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        r, leaves = y - p, [(np.arange(len(y)), 0)]

        def best(rows, depth):
            found = (0.0, None)
            if len(rows) < max(m.split, 2 * m.leaf) or (m.depth and depth >= m.depth):
                return found
            for f in range(bins.shape[1]):
                for b in np.unique(bins[rows, f]):
                    to_left = bins[rows, f] <= b
                    left, right = rows[to_left], rows[~to_left]
                    if min(len(left), len(right)) < m.leaf or not len(right):
                        continue
                    gain = len(left) * len(right) / len(rows) * (r[left].mean() - r[right].mean()) ** 2
                    if gain > max(found[0] * (1 + 1e-9), 1e-10 * len(rows)) and gain >= m.gain * len(y):
                        found = gain, (left, right)
            return found

        while len(leaves) < (m.leaves or 1000):
            options = [(*best(*leaf), leaf) for leaf in leaves]
            gain, cut, (rows, depth) = max(options, key=lambda o: o[0])
            if cut is None:
                break
            leaves = [x for x in leaves if x[0] is not rows] + [(part, depth + 1) for part in cut]
        for rows, _ in leaves:
            margin[rows] += m.rate * r[rows].sum() / (p[rows] * (1 - p[rows])).sum()
    return margin


@pytest.mark.parametrize("m", [Booster(rounds=3, depth=None, leaves=6, rate=0.5), Booster(rounds=2, depth=3, leaf=5), Booster(rounds=2, depth=None, split=40, gain=0.004)])
def test_trees_are_those_of_a_plain_booster(spark, m):
    df, x, y = table(spark)
    made = boosting.fit(df, ["a", "b", "c"], [m], "id", bins=16)[0]
    got = {r["id"]: r["score"] for r in made.transform(df).collect()}
    expected = 1 / (1 + np.exp(-plain(boosting.binned(x, made.edges), y, m, m.rounds)))
    assert np.allclose([got[i] for i in range(len(y))], expected, atol=1e-9)
    assert m.leaves is None or max((t.feature < 0).sum() for t in made.trees) == m.leaves


def test_folds_are_judged_and_models_share_passes(spark, monkeypatch):
    df, x, y = table(spark)
    alone = boosting.fit(df.filter("fold <> 1"), ["a", "b", "c"], [Booster(rounds=12, sample=0.5, features="sqrt", rate=0.2)], "id")[0]
    monkeypatch.setattr(boosting, "HELD", 1000)  # every node in a pass of its own
    monkeypatch.setattr(boosting, "TASK", 100)  # sums meet by shuffle
    ms = [Booster(rounds=4), Booster(rounds=12, sample=0.5, features="sqrt", rate=0.2, fold=1)]
    edges = alone.edges
    both = boosting.fit(df, ["a", "b", "c"], ms, "id", fold="fold", edges=edges)
    a, b = alone.transform(df), both[1].transform(df)
    assert np.allclose([r["score"] for r in a.orderBy("id").collect()], [r["score"] for r in b.orderBy("id").collect()])
    assert len(both[0].trees) == 4 and not both[0].loss and len(both[1].accuracy) == 13
    for n in (0, 7, 12):
        held = [r for r in both[1].transform(df, n).collect() if r["fold"] == 1]
        assert both[1].accuracy[n] == pytest.approx(np.mean([r["prediction"] == r["label"] for r in held]))
        assert both[1].loss[n] == pytest.approx(np.mean([-np.log(r["score"] if r["label"] else 1 - r["score"]) for r in held]))


def test_patience_empty_tables_and_one_class(spark):
    df, _, _ = table(spark)
    made = boosting.fit(df, ["c"], [Booster(rounds=100, rate=1.0, depth=6, fold=0, patience=3)], "id", fold="fold")[0]
    assert len(made.trees) < 100 and min(made.loss[-3:]) >= min(made.loss[:-3])
    nothing = boosting.fit(df.limit(0), ["a"], [Booster(rounds=2)], "id")[0]
    assert {r["score"] for r in nothing.transform(df).collect()} == {0.5}
    ones = boosting.fit(df.filter("label = 1"), ["a"], [Booster(rounds=2)], "id")[0]
    assert {r["prediction"] for r in ones.transform(df).collect()} == {1.0}
    assert boosting.fit(df, ["a"], [], "id") == []


def test_search_by_prefixes(spark):
    df, _, _ = table(spark)
    grid = {"rate": [0.1, 0.5], "depth": [None, 2], "leaves": [4], "trees": [2, 6], "warm": [True, False]}
    points = models.grid_rows(grid)
    best, made, scores = boosting.search(df, ["a", "b", "c"], points, "id", folds=3)
    assert best == points[int(np.argmax(scores))] and len(made.trees) == best["trees"]
    one = Booster(rate=0.5, depth=2, leaves=4, rounds=2)
    again = [boosting.fit(df, ["a", "b", "c"], [Booster(**{**one.__dict__, "fold": f})], "id", fold="fold")[0].accuracy[2] for f in range(3)]
    assert scores[points.index({"rate": 0.5, "depth": 2, "leaves": 4, "trees": 2, "warm": True})] == pytest.approx(np.mean(again))


def test_small_nodes_are_grown_by_one_task_to_the_same_tree(spark, monkeypatch):
    df, _, _ = table(spark)
    ms = [Booster(rounds=2, depth=None, leaves=9, rate=0.5), Booster(rounds=2, depth=4, sample=0.7, features="sqrt", gain=0.001, fold=1)]
    passes = []
    run = boosting._passed
    monkeypatch.setattr(boosting, "_passed", lambda *a: passes.append(len(a[5])) or run(*a))
    told = {}
    for small in (0, 90, 1000):  # no node, nodes below the root, all nodes
        passes.clear()
        monkeypatch.setattr(boosting, "SMALL", small)
        made = boosting.fit(df, ["a", "b", "c"], ms, "id", fold="fold")
        told[small] = [[(t.feature.tolist(), t.bin.tolist(), t.left.tolist(), t.value.round(9).tolist()) for t in m.trees] for m in made], [m.accuracy for m in made]
        assert small < 1000 or len(passes) == 3 and not any(passes)  # only folds are judged
    assert told[0] == told[90] == told[1000]


def test_forests_of_a_search_are_judged_together(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.tuning import CrossValidator

    df, _, _ = table(spark, 400)
    v = models.assembled(df.fillna(0.0).selectExpr("id", "a", "b", "c", "label", "fold % 2 AS fold"), ["a", "b", "c"])
    points = [{"numTrees": t, "maxDepth": d, "featureSubsetStrategy": f, "minInstancesPerNode": n} for t in (5, 40) for d in (1, 6) for f in ("sqrt", "all") for n in (1, 30)]
    fits = []
    monkeypatch.setattr(CrossValidator, "fit", lambda *a: fits.append(a))
    told = models.grid_search(v, RandomForestClassifier(seed=1), points, key="id")
    assert not fits and told.bestModel.getNumTrees == points[int(np.argmax(told.avgMetrics))]["numTrees"]
    monkeypatch.setattr(models.forests.boosting, "SMALL", 60)  # the tops are made by passes
    assert models.grid_search(v, RandomForestClassifier(seed=1), points, key="id").avgMetrics == pytest.approx(told.avgMetrics)
    for i in (12, 14, 15):  # forty trees, all depth 6 or all features: as good as Spark's own
        own = []
        for f in (0, 1):
            made = RandomForestClassifier(seed=1, **points[i]).fit(v.filter(f"fold <> {f}")).transform(v.filter(f"fold = {f}"))
            own.append(np.mean([r["prediction"] == r["label"] for r in made.collect()]))
        assert told.avgMetrics[i] == pytest.approx(np.mean(own), abs=0.06)


def test_the_best_forest_is_grown_without_a_pass_for_each_level(spark, monkeypatch, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier

    from quillmatch.sources import writers

    df, _, _ = table(spark, 400)
    v = models.assembled(df.fillna(0.0).selectExpr("id", "a", "b", "c", "label", "fold % 2 AS fold"), ["a", "b", "c"])
    forest, point = RandomForestClassifier(seed=1), {"numTrees": 20, "maxDepth": 30, "featureSubsetStrategy": "all", "minInstancesPerNode": 1}
    own = forest.copy({getattr(forest, k): x for k, x in point.items()}).fit(v)
    monkeypatch.setattr(RandomForestClassifier, "fit", None)
    shares = {}
    for small in (1 << 15, 60, 0):  # all in tasks, tops by passes, and the whole trees
        monkeypatch.setattr(models.forests.boosting, "SMALL", small)
        made = models.grid_search(v, forest, [point], key="id").bestModel
        shares[small] = {r["id"]: r["probability"][1] for r in made.transform(v).collect()}
    assert shares[0] == pytest.approx(shares[60]) and shares[0] == pytest.approx(shares[1 << 15])
    assert np.mean([r["prediction"] == r["label"] for r in made.transform(v).collect()]) > 0.97  # each row is in most trees, and they end in single rows
    assert np.allclose(made.featureImportances.toArray(), own.featureImportances.toArray(), atol=0.05)
    writers.save_models({"rf": made}, str(tmp_path))
    again = writers.load_models(spark, str(tmp_path), ["rf"])["rf"]
    assert again.getNumTrees == 20 and {r["id"]: r["probability"][1] for r in again.transform(v).collect()} == shares[0]
    leaf = models.refitted(v, forest, point | {"maxDepth": 0, "numTrees": 500}, "id")
    assert leaf.transform(v).first()["probability"][1] == pytest.approx(np.mean([r["label"] for r in df.collect()]), abs=0.01)
    stump = models.refitted(v, forest, point | {"maxDepth": 1}, "id")
    assert {len(t.feature) for t in stump.trees} == {3}


def test_trees_of_few_leaves_take_few_passes_and_sums_are_the_same_by_feature(spark, monkeypatch):
    df, _, _ = table(spark)
    m = Booster(rounds=2, depth=None, leaves=9, rate=0.5, fold=1)
    passes, told = [], {}
    run = boosting._passed
    monkeypatch.setattr(boosting, "_passed", lambda *a: passes.append(len(a[5])) or run(*a))
    for small, long in ((0, 1 << 40), (75, 1 << 40), (75, 1)):  # the root has 200 rows
        monkeypatch.setattr(boosting, "SMALL", small)
        monkeypatch.setattr(boosting, "LONG", long)
        passes.clear()
        made = boosting.fit(df, ["a", "b", "c"], [m], "id", fold="fold")[0]
        told[small, long] = [(t.feature.tolist(), t.bin.tolist(), t.value.round(9).tolist()) for t in made.trees], made.accuracy
        assert not small or len(passes) == 3 and not any(passes)
    assert told[0, 1 << 40] == told[75, 1 << 40] == told[75, 1]
    x, s = np.random.default_rng(1).integers(0, 16, (500, 5)).astype(np.uint8), np.random.default_rng(2).normal(size=(500, 4))
    monkeypatch.setattr(boosting, "LONG", 1)
    by_feature = boosting.histogram(x, s, 16)
    monkeypatch.setattr(boosting, "LONG", 1 << 40)
    assert (by_feature == boosting.histogram(x, s, 16)).all()
