"""Registered searches take whole grids, and what tasks grow at once is what is grown node by node."""

import numpy as np
import pytest

from quillmatch.operators import boosting, forests, models
from quillmatch.operators.boosting import Booster
from quillmatch.plans import profile_queries
from quillmatch.plans.catalog import Tables


class Asked(Exception):
    pass


def asked(monkeypatch, module, name, query, spark):
    def stop(*args, **kwargs):
        raise Asked(args, kwargs)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Asked) as told:
        query(Tables(spark, "/root/testdata/sf0.001"))
    return told.value.args


def test_forest_searches_ask_for_every_tree_of_the_grid(spark, monkeypatch):
    whole = [models.spark_params(p) for p in models.grid_rows(models.GRIDS["rf"])]
    args, _ = asked(monkeypatch, models, "grid_search", profile_queries.rf_grid_search, spark)
    assert args[2] == whole and {p["numTrees"] for p in args[2]} == {500, 1000}
    args, _ = asked(monkeypatch, models, "search_refit_predict", profile_queries.search_refit_test, spark)
    assert args[2]["rf"] == whole


def rows(n=900, width=9, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 16, (n, width)).astype(np.uint8)
    y = ((x[:, 0] > 7) ^ (x[:, 1] > 5)).astype(float)
    return x, np.where(rng.random(n) < 0.1, 1 - y, y), rng.poisson(1, n), rng.random(n)


@pytest.mark.parametrize("m", [Booster(depth=None, features="sqrt"), Booster(depth=4, leaf=3, split=9), Booster(depth=None, gain=0.001)])
@pytest.mark.parametrize("sorted_", [0, 50, 1 << 20])
def test_levels_are_what_is_grown_node_by_node(monkeypatch, m, sorted_):
    monkeypatch.setattr(boosting, "SORTED", sorted_)
    monkeypatch.setattr(boosting, "SORTED_AT_ONCE", 1000)
    x, y, times, p = rows()
    for even in (True, False):
        s = boosting.numbers(times, y, np.where(y > 0, 2.0, 1.0), np.full(len(y), 0.5) if even else p)[times > 0]
        told = boosting.grown_below(x[times > 0], s, 1, m, None, [0, 7], 16)
        nodes, r = boosting.grown_levels(x[times > 0], s, 1, m, None, [0, 7], 16, even)
        got = dict(zip(nodes.tolist(), r, strict=True))
        assert {n for n, v in told.items() if v[0] >= 0} == {n for n, v in got.items() if v[0] >= 0} and len(got) > 10
        for n, v in got.items():
            assert v[:2].tolist() == told[n][:2] and v == pytest.approx(told[n], abs=1e-8)


def test_a_forest_s_votes_are_those_of_its_nodes():
    x, y, times, _ = rows()
    m = Booster(depth=30, leaves=1 << 40, features="sqrt", bag=2)
    tree, gains = forests._grown(x, y, np.ones(len(y)), times, m, 0, 16)
    s = boosting.numbers(times, y, np.ones(len(y)), np.full(len(y), 0.5))[times > 0]
    told = boosting.grown_below(x[times > 0], s, 1, m, 0.0, [0, 2], 16)
    assert np.allclose(forests._told(tree, x, [0, 2, 30]), forests._votes(told, 1, x, m, [0, 2, 30], [0.5] * 3))
    assert gains.sum() == pytest.approx(sum(v[2] for v in told.values() if v[0] >= 0))
    assert (tree.reached(x[times > 0]) < len(tree.feature)).all() and (tree.feature < 0).sum() == (tree.feature >= 0).sum() + 1


def test_the_boosted_search_asks_for_every_round_of_the_grid(spark, monkeypatch):
    args, more = asked(monkeypatch, boosting, "search", profile_queries.gbt_search, spark)
    assert args[2] == models.grid_rows(models.GRIDS["gbt"]) and "share" not in more
    fits = []

    def fit(df, columns, ms, *a, **k):
        fits.append(sorted({m.rounds for m in ms}))
        return [boosting.Boosted(columns, k["edges"], accuracy=[0.5] * (m.rounds + 1)) for m in ms]

    monkeypatch.undo()
    monkeypatch.setattr(boosting, "fit", fit)
    profile_queries.gbt_search(Tables(spark, "/root/testdata/sf0.001"))
    assert fits == [[300], [150]]


def test_models_that_tasks_fit_alone_are_those_of_shared_passes(spark):
    x, y, _, _ = rows(300, 3)
    df = spark.createDataFrame([(i, *map(float, v), int(t), i % 2) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, label int, fold int")
    ms = [Booster(rounds=4, depth=None, sample=0.7, fold=0), Booster(rounds=3, depth=3, features="sqrt", rate=0.5, fold=1), Booster(rounds=40, rate=2.0, leaves=6, fold=1, patience=3)]
    one, other = (boosting.fit(df, ["a", "b", "c"], ms, "id", fold="fold", apart=a) for a in (True, False))
    for a, b in zip(one, other, strict=True):
        assert a.loss == pytest.approx(b.loss) and a.accuracy == pytest.approx(b.accuracy) and len(a.trees) == len(b.trees)
        assert [t.feature.tolist() for t in a.trees] == [t.feature.tolist() for t in b.trees]
