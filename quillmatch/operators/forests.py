"""Random forests: many of them judged on held-out rows together, and one fitted, each by one shuffle of its rows.

Forests that differ in their depth or number of trees alone are one: fewer trees are a prefix, a lower depth is the top of
the same trees. A tree is a booster's first one from a chance of a half, whose gain is then Gini's: large nodes are split by
shared passes of sums; the rows of a node with few enough, fitted or held out, meet in one task, which grows all below and
lets its held-out rows vote. Votes are added up row by row; no tree below a large node leaves its task. The best forest is
grown in the same way, where Spark's own takes a pass for each of its levels, and its trees are brought together.

Of up to SMALL * MORE rows no row is sent: the bins of all (8 MB of 64 features) are read by tasks that grow some trees each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.operators import boosting
from quillmatch.operators.boosting import Booster, Tree
from quillmatch.sources.scratch import drop_table, written

#: The parameters of Spark's forests that are told apart here.
PARAMETERS = {"numTrees", "maxDepth", "featureSubsetStrategy", "minInstancesPerNode"}


def known(estimator, points: list[dict]) -> bool:
    """Whether these points of Spark's forests can be judged here."""
    strategies = {p.get("featureSubsetStrategy", estimator.getFeatureSubsetStrategy()) for p in points}
    plain = estimator.getMinInfoGain() == 0 and estimator.getSubsamplingRate() == 1 and estimator.getMinWeightFractionPerNode() == 0 and estimator.getImpurity() == "gini"
    return bool(points) and plain and all(p.keys() <= PARAMETERS for p in points) and strategies <= {"auto", "sqrt", "all"}


def _alike(estimator, point: dict) -> tuple[Booster, int, int]:
    """What a point's trees share with others but their depth, then depth and number."""
    trees = point.get("numTrees", estimator.getNumTrees())
    how = point.get("featureSubsetStrategy", estimator.getFeatureSubsetStrategy())
    leaf = point.get("minInstancesPerNode", estimator.getMinInstancesPerNode())
    every = how == "all" or (how == "auto" and trees == 1)
    return Booster(rate=0.25, rounds=1, depth=None, leaves=1 << 40, leaf=leaf, split=2 * leaf, features=None if every else "sqrt"), point.get("maxDepth", estimator.getMaxDepth()), trees


def _mean(sums) -> float:
    """The share of label 1, of a node's sums."""
    return 0.5 + sums[2] / sums[1] if sums[1] > 1e-150 else 0.5


def _votes(found: dict[int, list[float]], root: int, x: np.ndarray, m: Booster, depths: list[int], above: list[float]) -> np.ndarray:
    """A row of shares of label 1 for each depth: what the tree cut off there says of x. above: for depths over the root's."""
    out = np.tile(np.array(above, float)[:, None], (1, len(x)))
    open_ = [(root, np.arange(len(x)), _mean(found[root][7:11]))]
    while open_:
        n, rows, share = open_.pop()
        r, level = found.get(n), n.bit_length() - 1
        ends = r is None or r[0] < 0 or r[7] < m.split or level >= max(depths)
        for i, d in enumerate(depths):
            if level == d or (ends and level < d):
                out[i, rows] = share
        if not ends:
            to_left = x[rows, r[0]] <= r[1]
            for child, own, sums in ((2 * n, rows[to_left], r[3:7]), (2 * n + 1, rows[~to_left], np.subtract(r[7:11], r[3:7]))):
                if len(own):
                    open_.append((child, own, _mean(sums)))
    return out


def _tops(rows: DataFrame, width: int, bins: int, models: list[Booster], sizes: list[float], seed: int, tasks: int) -> list[boosting._Grower]:
    """The trees as far as their nodes have more than SMALL rows."""
    growers = [boosting._Grower(m) for m in models]
    while True:
        wanted = []
        for i, g in enumerate(growers):
            split, open_ = g.step()
            tree, number = g.tree(split)
            wanted += [(i, n, tree, number[n]) for n in open_ if g.rows(n, sizes[i]) > boosting.SMALL]
        if not wanted:
            return growers
        for part in boosting._portions(wanted, width, bins, models):
            grown, names = {}, {}
            for k, (i, n, tree, number) in enumerate(part):
                growers[i].drawn[n] = boosting._features(width, models[i].features, [seed, models[i].bag, n])
                grown.setdefault(i, (tree, {}))[1][number] = (k, models[i].leaf, growers[i].drawn[n])
                names[k] = i, n
            found = boosting._passed(rows, width, bins, models, [[] for _ in models], grown, 0, set(), tasks)
            for k, (i, n) in names.items():
                growers[i].look({n: found.get(k, [-1, *[0.0] * 10])})


#: Tasks for each core that the trees of a search are dealt to, dearest first.
WAVES = 8


def _grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, times: np.ndarray, m: Booster, seed: int, bins: int) -> tuple[Tree, np.ndarray]:
    """A tree whose values are shares of label 1, of all its nodes, and what each feature's splits take away."""
    own, width = np.flatnonzero(times), x.shape[1]
    if not len(own):
        return Tree(np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, 0.5)), np.zeros(width)
    s = boosting.numbers(times[own], y[own], w[own], np.full(len(own), 0.5))
    nodes, r = boosting.grown_levels(x[own], s, 1, Booster(**{**m.__dict__, "depth": m.depth or 1}), 0.0, [seed, m.bag], bins, even=True)
    split = (r[:, 0] >= 0) & (r[:, 7] >= m.split) & (np.log2(nodes).astype(int) < m.depth)
    at = np.flatnonzero(split)
    # the root, and the halves of what is split: nodes come level by level, so a node's number is told by its parent's place
    left = np.zeros(len(nodes), np.int64)
    left[at] = 1 + 2 * np.arange(len(at))
    number = np.zeros(len(nodes), np.int64)
    parents = np.searchsorted(nodes, nodes[1:] // 2)
    number[1:] = left[parents] + nodes[1:] % 2
    n = 1 + 2 * len(at)
    out = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))
    out.feature[number[at]], out.bin[number[at]], out.left[number[at]] = r[at, 0], r[at, 1], left[at]
    halves = np.stack([r[at, 3:7], r[at, 7:11] - r[at, 3:7]], 1).reshape(-1, 4)
    sums = np.concatenate([r[:1, 7:11], halves])
    out.value[:] = np.where(sums[:, 1] > 1e-150, 0.5 + sums[:, 2] / np.maximum(sums[:, 1], 1e-150), 0.5)
    return out, np.bincount(r[at, 0].astype(int), r[at, 2], width)


def _told(tree: Tree, x: np.ndarray, depths: list[int]) -> np.ndarray:
    """_votes of a tree that holds the shares of all its nodes."""
    out, at, rows, level = np.empty((len(depths), len(x))), np.zeros(len(x), np.int64), np.arange(len(x)), 0
    while len(rows):
        for i, d in enumerate(depths):
            if d == level:
                out[i] = tree.value[at]
        f = tree.feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        own = at[rows]
        at[rows] = tree.left[own] + (x[rows, f] > tree.bin[own])
        level += 1
    for i, d in enumerate(depths):
        if d >= level:
            out[i] = tree.value[at]
    return out


#: What is sent of a batch to an end of a tree: fitted rows with their numbers, then held-out ones.
SENT = "key long, x binary, s binary, hx binary, id binary, y binary"


def _sent(models: list[Booster], tops: list[tuple[Tree, dict[int, int]]], width: int):
    """Sends rows of bins, fitted and held out, to the ends of their trees' tops. tops: a tree, and its ends' keys."""

    def sent(batches):
        import pyarrow as pa

        kinds = [pa.int64(), *[pa.binary()] * 5]
        for b in batches:
            if not b.num_rows:
                continue
            x, y, w, fold, h, _ = boosting._read(b, width)
            ids = b.column("id").to_numpy()
            for m, (tree, ends) in zip(models, tops, strict=True):
                times, at, out = boosting.counts(m, h, fold, 0), tree.reached(x), []
                for end, k in ends.items():
                    own, held = np.flatnonzero((at == end) & (times > 0)), np.flatnonzero((at == end) & (fold == m.fold))
                    if len(own) or len(held):
                        s = boosting.numbers(times[own], y[own], w[own], np.full(len(own), 0.5))
                        out.append((k, x[own].tobytes(), s.tobytes(), x[held].tobytes(), ids[held].tobytes(), y[held].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "x", "s", "hx", "id", "y"])

    return sent


class Binned:
    """The rows of a table that forests are fitted to, their features in bins, written once; drop() deletes them.

    binary: whether no label is another than 0 and 1. sizes: rows by fold.
    """

    def __init__(self, train: DataFrame, estimator, fold: str | None, key: str | None, bins: int):
        label, weight = estimator.getLabelCol(), estimator.getWeightCol() if estimator.isSet("weightCol") else None
        given = train.withColumn("__x", vector_to_array(estimator.getFeaturesCol())).withColumn("__key", F.monotonically_increasing_id() if key is None else F.col(key))
        given = written(given.select("__x", "__key", label, *filter(None, [fold, weight])), "forest")
        first = given.filter(F.col("__x").isNotNull()).first()
        self.bins, self.width, self.rows, self.binary = bins, 0 if first is None else len(first["__x"]), None, True
        if self.width:
            self.edges = boosting.array_edges(given.filter(F.col(label).isNotNull()).select(F.col("__x").alias("x")), self.width, bins)
            x = F.coalesce("__x", F.array_repeat(F.lit(float("nan")), self.width))
            base, self.tasks = boosting._prepared(given, x, self.edges, "__key", label, fold, weight, 1)
            self.rows = written(base.withColumns({"id": F.monotonically_increasing_id(), "m": F.array(F.lit(0.0))}).repartition(self.tasks), "forest")
            drop_table(base)
            told = self.rows.groupBy("fold").agg(F.count("*").alias("n"), F.bool_and(F.col("y").isin(0.0, 1.0)).alias("binary")).collect()
            self.sizes, self.binary = {r["fold"]: r["n"] for r in told}, all(r["binary"] for r in told)
        drop_table(given)

    @property
    def small(self) -> bool:
        """Whether the rows are no more than a small node of few leaves has: tasks then read them all and share the trees."""
        return sum(self.sizes.values()) <= boosting.SMALL * boosting.MORE

    def drop(self) -> None:
        if self.rows is not None:
            drop_table(self.rows)

    def tops(self, models: list[Booster], seed: int) -> list[boosting._Grower]:
        """The trees as far as their nodes have more than SMALL rows."""
        return _tops(self.rows, self.width, self.bins, models, [sum(n for f, n in self.sizes.items() if f != m.fold) for m in models], seed, self.tasks)


def held_out_accuracy(data: Binned, estimator, points: list[dict], folds: int, seed: int = 0) -> list[float]:
    """Of each point of Spark's parameters, the mean accuracy over the folds of the forest that is fitted to the others.

    A tree draws rows with replacement by a digest of the key, and features by tree and node. A fold without rows has no say.
    """
    if data.rows is None:
        return [0.0] * len(points)

    told = [_alike(estimator, p) for p in points]
    sets = [(s, f) for s in dict.fromkeys(s for s, _, _ in told) for f in range(folds)]
    depths = sorted({d for _, d, _ in told})
    models, of = [], []
    for i, (s, f) in enumerate(sets):
        deepest = max(d for a, d, _ in told if a == s)
        for t in range(max(n for a, _, n in told if a == s)):
            models.append(Booster(**{**s.__dict__, "depth": deepest or 1, "fold": f, "bag": t * folds + f}))
            of.append((i, t))
    width, bins = data.width, data.bins
    asked = sorted({(d, n) for _, d, n in told})
    if data.small:
        accuracy = _judged_apart(data, models, of, depths, asked, folds, seed)
        return _means(told, sets, accuracy)
    growers = data.tops(models, seed)
    tops, roots = [], {}
    for i, g in enumerate(growers):
        split, _ = g.step()
        tree, number = g.tree(split)
        ends = {at: n for n, at in number.items() if n not in split}
        tops.append((tree, {at: len(roots) + k for k, at in enumerate(ends)}))
        for n in ends.values():
            path = [n >> up for up in range(n.bit_length() - 1, 0, -1)]  # the nodes above it, the root first
            shares = [_mean(g.known[a][7:11]) for a in path]
            roots[len(roots)] = i, n, [shares[d] if d < len(shares) else 0.5 for d in depths]

    def voted(table):
        import pyarrow as pa

        i, n, above = roots[table.column("key")[0].as_py()]
        x, s, hx, ids, y = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("x", np.uint8), ("s", float), ("hx", np.uint8), ("id", np.int64), ("y", float)))
        x, s, hx = x.reshape(-1, width), s.reshape(-1, 4), hx.reshape(-1, width)
        m, (number, tree) = models[i], of[i]
        found = boosting.grown_below(x, s, n, m, 0.0, [seed, m.bag], bins)
        shares = _votes(found, n, hx, m, depths, above)
        return pa.table({"set": pa.array(np.full(len(ids), number, np.int32)), "tree": pa.array(np.full(len(ids), tree, np.int32)), "id": pa.array(ids), "y": pa.array(y), **{f"p{d}": pa.array(v) for d, v in zip(depths, shares, strict=True)}})

    groups = data.rows.mapInArrow(_sent(models, tops, width), SENT)
    votes = groups.repartition(min(len(roots), 64), "key").groupBy("key").applyInArrow(voted, "set int, tree int, id long, y double, " + ", ".join(f"p{d} double" for d in depths))
    sums = votes.groupBy("set", "id", "y").agg(*[F.avg(F.when(F.col("tree") < n, F.col(f"p{d}"))).alias(f"p{d}_{n}") for d, n in asked])
    right = sums.groupBy("set").agg(*[F.avg(((F.col(f"p{d}_{n}") > 0.5) == (F.col("y") > 0.5)).cast("int")).alias(f"p{d}_{n}") for d, n in asked])
    return _means(told, sets, {r["set"]: r for r in right.collect()})


def _means(told: list[tuple[Booster, int, int]], sets: list[tuple[Booster, int]], accuracy: dict) -> list[float]:
    """The mean accuracy of each point over the folds that have rows."""
    out = []
    for s, d, n in told:
        own = [accuracy[i][f"p{d}_{n}"] for i, (a, _) in enumerate(sets) if a == s and i in accuracy]
        out.append(float(np.mean(own)) if own else 0.0)
    return out


def _parts(models: list[Booster], cores: int) -> list[list[int]]:
    """Models in parts of about the same work, WAVES for each core: a tree with all features counts as eight."""
    cost = [8 if m.features is None else 1 for m in models]
    order = sorted(range(len(models)), key=lambda i: -cost[i])
    each = max(1.0, sum(cost) / (WAVES * cores))
    part = (np.cumsum([cost[i] for i in order]) - 1) // each
    return [p.tolist() for p in np.split(np.array(order), np.flatnonzero(np.diff(part)) + 1)]


def _judged_apart(data: Binned, models: list[Booster], of: list[tuple[int, int]], depths: list[int], asked: list[tuple[int, int]], folds: int, seed: int) -> dict:
    """set -> accuracies of what is asked for (depth, number of trees). Tasks read the rows and grow some trees each; what
    they send is a sum of votes for each held-out row, set and number of trees."""
    spark, path, n, width, bins = data.rows.sparkSession, data.rows.written_to, sum(data.sizes.values()), data.width, data.bins
    parts, names = _parts(models, spark.sparkContext.defaultParallelism), [f"p{d}_{k}" for d, k in asked]

    def run(batches):
        import pyarrow as pa

        x, y, w, fold, h, ids = boosting.whole(path, n, width, ("y", "w", "fold", "h", "id"))
        for part in [parts[k] for b in batches for k in b.column(0).to_pylist()]:
            sums, held = {}, {}
            for i in part:
                m, (number, tree) = models[i], of[i]
                if m.fold not in held:
                    held[m.fold] = np.flatnonzero(fold == m.fold)
                if not len(held[m.fold]):
                    continue
                made, _ = _grown(x, y, w, boosting.counts(m, h, fold, 0), m, seed, bins)
                own, shares = sums.setdefault((number, m.fold), np.zeros((len(asked), len(held[m.fold])))), _told(made, x[held[m.fold]], depths)
                for j, (d, k) in enumerate(asked):
                    if tree < k:
                        own[j] += shares[depths.index(d)]
            for (number, f), v in sums.items():
                rows = held[f]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int32)), pa.array(ids[rows]), pa.array(y[rows]), *map(pa.array, v)], ["set", "id", "y", *names])

    votes = spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "set int, id long, y double, " + ", ".join(f"{c} double" for c in names))
    sums = votes.groupBy("set", "id", "y").agg(*[(F.sum(c) / k).alias(c) for c, (_, k) in zip(names, asked, strict=True)])
    right = sums.groupBy("set").agg(*[F.avg(((F.col(c) > 0.5) == (F.col("y") > 0.5)).cast("int")).alias(c) for c in names])
    return {r["set"]: r for r in right.collect()}


def _fitted_apart(data: Binned, models: list[Booster], seed: int) -> tuple[list[Tree], np.ndarray]:
    """The trees, and what each feature's splits take away in each: tasks read the rows and grow some trees each."""
    spark, path, n, width, bins = data.rows.sparkSession, data.rows.written_to, sum(data.sizes.values()), data.width, data.bins
    parts = _parts(models, spark.sparkContext.defaultParallelism)

    def run(batches):
        import pyarrow as pa

        x, y, w, fold, h = boosting.whole(path, n, width)
        for i in [i for b in batches for k in b.column(0).to_pylist() for i in parts[k]]:
            m = models[i]
            made, gains = _grown(x, y, w, boosting.counts(m, h, fold, 0), m, seed, bins)
            columns = [np.asarray(getattr(made, c), kind).tobytes() for c, kind in boosting.KINDS.items()]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *[pa.array([v], pa.binary()) for v in (*columns, gains.tobytes())]], ["i", *boosting.KINDS, "gains"])

    each = spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "i long, " + ", ".join(f"{c} binary" for c in boosting.KINDS) + ", gains binary")
    found = {r["i"]: r for r in each.collect()}
    trees = [Tree(*[np.frombuffer(found[i][c], kind) for c, kind in boosting.KINDS.items()]) for i in range(len(models))]
    return trees, np.array([np.frombuffer(found[i]["gains"]) for i in range(len(models))]).reshape(len(models), width)


def _subtree(found: dict[int, list[float]], root: int, m: Booster, width: int) -> tuple[np.ndarray, ...]:
    """feature (-1: a leaf), bin, the left half's number, share of label 1 of the nodes below root; what each feature's splits take away."""
    order, shares, gains = [root], [_mean(found[root][7:11])], np.zeros(width)
    feature, bin_, left = [], [], []
    for n in order:
        r = found.get(n)
        if r is None or r[0] < 0 or r[7] < m.split or n.bit_length() - 1 >= m.depth:
            feature.append(-1)
            bin_.append(0)
            left.append(0)
            continue
        feature.append(r[0])
        bin_.append(int(r[1]))
        left.append(len(order))
        gains[r[0]] += r[2]
        order += [2 * n, 2 * n + 1]
        shares += [_mean(r[3:7]), _mean(np.subtract(r[7:11], r[3:7]))]
    return np.array(feature, np.int32), np.array(bin_, np.int32), np.array(left, np.int32), np.array(shares), gains


def fit(data: Binned, estimator, point: dict, seed: int = 0) -> ForestModel:
    """The forest of a point of Spark's parameters, fitted to all rows; shares of label 1 are averaged over its trees."""
    alike, depth, n = _alike(estimator, point)
    if data.rows is None:
        leaf = Tree(np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, 0.5))
        return ForestModel.of(estimator, np.zeros((data.width, data.bins - 2)), [leaf] * n, np.zeros(data.width))
    models = [Booster(**{**alike.__dict__, "depth": depth, "bag": t}) for t in range(n)]
    width, bins = data.width, data.bins
    if data.small:
        trees, gains = _fitted_apart(data, models, seed)
        return _model(estimator, data, trees, gains)
    # a tree of no depth is a leaf: one level is grown for its sums, and cut off
    growers = data.tops([Booster(**{**m.__dict__, "depth": depth or 1}) for m in models], seed)
    tops, roots, whole, gains = [], {}, [], np.zeros((n, width))
    for i, g in enumerate(growers):
        split, _ = g.step()
        split = split if depth else []
        tree, number = g.tree(split)
        ends = {}
        for node, at in number.items():
            if node in split:
                gains[i, g.known[node][0]] += g.known[node][2]
            elif node in g.known and (not depth or g.known[node][0] < 0):
                tree.value[at] = _mean(g.known[node][7:11])  # nothing splits it, so its rows need not meet
            elif node > 1 and node.bit_length() - 1 >= depth:
                r = g.known[node // 2]
                tree.value[at] = _mean(np.subtract(r[7:11], r[3:7]) if node % 2 else r[3:7])
            else:
                tree.value[at], ends[at] = 0.5, len(roots)
                roots[len(roots)] = i, node, at
        tops.append((tree, ends))
        whole.append([[tree.feature], [tree.bin], [tree.left], [tree.value]])

    def grown(table):
        import pyarrow as pa

        key = table.column("key")[0].as_py()
        i, node, _ = roots[key]
        x, s = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("x", np.uint8), ("s", float)))
        found = boosting.grown_below(x.reshape(-1, width), s.reshape(-1, 4), node, models[i], 0.0, [seed, models[i].bag], bins)
        return pa.table({"key": pa.array([key], pa.int64()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("f", "b", "l", "v", "g"), _subtree(found, node, models[i], width), strict=True)}})

    groups = data.rows.mapInArrow(_sent(models, tops, width), SENT).repartition(min(len(roots), 64) or 1, "key").groupBy("key")
    for r in sorted(groups.applyInArrow(grown, "key long, f binary, b binary, l binary, v binary, g binary").collect(), key=lambda r: r["key"]) if roots else []:
        i, _, at = roots[r["key"]]
        feature, bin_, left = (np.frombuffer(r[c], np.int32).astype(np.int64) for c in ("f", "b", "l"))
        value, parts = np.frombuffer(r["v"]), whole[i]
        # its root takes the place of the top's end, the others follow those that are there
        shift = sum(map(len, parts[0])) - 1
        left = np.where(feature >= 0, left + shift, 0)
        for own, v in zip(parts, (feature, bin_, left, value), strict=True):
            own[0][at] = v[0]
            own.append(v[1:])
        gains[i] += np.frombuffer(r["g"])
    return _model(estimator, data, [Tree(*map(np.concatenate, parts)) for parts in whole], gains)


def _model(estimator, data: Binned, trees: list[Tree], gains: np.ndarray) -> ForestModel:
    share = gains / np.maximum(gains.sum(1, keepdims=True), 1e-300)
    total = share.sum(0)
    return ForestModel.of(estimator, data.edges, trees, total / total.sum() if total.sum() else total)


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, MLWritable, MLReadable):
    """A fitted forest for labels 0 and 1: edges of the features' bins, trees over these whose values are shares of label 1."""

    edges: np.ndarray
    trees: list[Tree]
    featureImportances = None

    @classmethod
    def of(cls, estimator, edges: np.ndarray, trees: list[Tree], importances: np.ndarray) -> ForestModel:
        from pyspark.ml.linalg import DenseVector

        out = cls()
        out._set(featuresCol=estimator.getFeaturesCol(), predictionCol=estimator.getPredictionCol(), probabilityCol=estimator.getProbabilityCol())
        out.edges, out.trees, out.featureImportances = edges, trees, DenseVector(importances)
        return out

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def numFeatures(self) -> int:
        return len(self.edges)

    def _transform(self, df: DataFrame) -> DataFrame:
        edges, trees = self.edges, self.trees

        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            bins = boosting.binned(np.array(x.tolist(), dtype=float).reshape(len(x), -1), edges)
            return pd.Series(np.mean([t.value[t.reached(bins)] for t in trees], 0))

        share = F.pandas_udf(run, "double")(vector_to_array(self.getFeaturesCol()))
        out = df.withColumn("__share", share).withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - F.col("__share"), F.col("__share"))))
        return out.withColumn(self.getPredictionCol(), (F.col("__share") > 0.5).cast("double")).drop("__share")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        import pyarrow as pa

        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, {"edges": m.edges.tolist(), "importances": m.featureImportances.toArray().tolist()})
        rows = {"tree": np.arange(len(m.trees)), **{c: pa.array([getattr(t, c).tolist() for t in m.trees]) for c in ("feature", "bin", "left", "value")}}
        self.sparkSession.createDataFrame(pa.table(rows)).write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        from pyspark.ml.linalg import DenseVector

        told, out = DefaultParamsReader.loadMetadata(path, self.sparkSession), ForestModel()
        out._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(out, told)
        out.edges, out.featureImportances = np.array(told["edges"], float), DenseVector(told["importances"])
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").toArrow()
        columns = [[v.values.to_numpy() for v in rows.column(c)] for c in ("feature", "bin", "left", "value")]
        out.trees = [Tree(*each) for each in zip(*columns, strict=True)]
        return out
