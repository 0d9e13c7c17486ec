"""Gradient boosting whose trees grow leaf by leaf, and searches over it, all models in shared passes.

Columns become bins once. A pass sums, for every open node of every model, how many rows, how much weight, gradient and
curvature each bin of each feature holds; sums meet on the executors, node by node, and only the best split of a node
reaches the driver. The rows of a node that has few enough are sent to one task, which grows all that is below it: a
round of all models takes as many passes as the deepest tree has levels of larger nodes, and one more.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from heapq import heappop, heappush
from math import ceil, factorial

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.sources.scratch import drop_table, written

#: Bins of a column; numbers that a task holds of the nodes of one pass; rounds, and nodes of trees, between two
#: writings of the margins.
BINS, HELD, EVERY, LATE = 64, 1 << 23, 10, 500

#: Rows of a node below which one task grows the rest.
SMALL = 1 << 15

#: Of a tree of no more than so many leaves, nodes of so many times as many: little is below them.
FEW, MORE = 64, 4

#: Rows that are summed feature by feature.
LONG = 1 << 12

#: Splits whose gains differ by a smaller share are equal: their sums may have been added up in another order.
TIED = 1e-9

#: Rows of a node below which its splits are found by sorting; rows times features that are sorted at once.
SORTED, SORTED_AT_ONCE = 256, 1 << 18

#: Leaves and levels of a tree that names no limit of them.
MOST_LEAVES, DEEPEST = 1024, 30

#: Rows times features that are worth a task.
TASK = 1 << 19


@dataclass(frozen=True)
class Booster:
    """A model to be fitted. fold: its rows are judged and not fitted (None: every row is fitted).

    leaf, split: the fewest rows of a leaf and of a node that is split. gain: the least share of the squared error of a
    row that a split takes away. features: 'sqrt', or None for all. sample: the share of the rows that a round sees.
    patience: rounds without a gain in the fold's loss after which it ends (None: it never does). bag: the number of a
    tree that sees rows as often as they are drawn with replacement (None: once).
    """

    rate: float = 0.1
    rounds: int = 100
    depth: int | None = 3
    leaves: int | None = None
    leaf: int = 1
    split: int = 2
    gain: float = 0.0
    features: str | None = None
    sample: float = 1.0
    fold: int | None = None
    patience: int | None = None
    bag: int | None = None


@dataclass
class Tree:
    """Nodes by number, the root first: feature (-1: a leaf), bin (up to it: left), the left one's number (right: the next), value."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            f = self.feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            own = at[rows]
            at[rows] = self.left[own] + (bins[rows, f] > self.bin[own])
        return at


@dataclass
class Boosted:
    """A fitted model: a margin is `base` and the values of the trees. loss, accuracy: of its fold, by the number of trees, none first."""

    columns: list[str]
    edges: np.ndarray
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    loss: list[float] = field(default_factory=list)
    accuracy: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame, rounds: int | None = None) -> DataFrame:
        """df with prediction and score (the chance of label 1) by the first `rounds` trees."""
        edges, base, trees = self.edges, self.base, self.trees[:rounds]

        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            bins = binned(np.array(x.tolist(), dtype=float), edges)
            return pd.Series(_chance(base + sum((t.value[t.reached(bins)] for t in trees), np.zeros(len(x)))))

        return df.withColumn("score", F.pandas_udf(run, "double")(columns_array(self.columns))).withColumn("prediction", (F.col("score") > 0.5).cast("double"))


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def column_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> np.ndarray:
    """A row of bins - 2 rising edges a column: quantiles of its values but NaN, off by no more than a rank in 10,000.
    Bin 0 is for missing values. Columns without values: infinities."""
    return array_edges(df.select(columns_array(columns).alias("x")), len(columns), bins)


def array_edges(df: DataFrame, width: int, bins: int = BINS) -> np.ndarray:
    """column_edges of the places of the array x, which are groups: a plan of one quantile, however wide."""
    shares = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    values = df.select(F.posexplode("x").alias("i", "v")).filter(~F.isnan("v"))
    out = np.full((width, bins - 2), np.inf)
    for r in values.groupBy("i").agg(F.percentile_approx("v", shares, F.lit(10_000)).alias("e")).collect():
        out[r["i"]] = r["e"]
    return out


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins of rows of numbers: 0 for NaN, else one more than how many edges lie below the number."""
    out = np.zeros(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(e, x[:, i]))
    return out


def _drawn(h: np.ndarray, round_: int, share: float) -> np.ndarray:
    """Which rows a round sees, by a digest of theirs."""
    return np.ones(len(h), bool) if share >= 1 else _digest(h, round_) < np.uint64(int(share * 2.0**64))


def _digest(h: np.ndarray, round_: int) -> np.ndarray:
    z = h.view(np.uint64) ^ np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(times)
    return z ^ (z >> np.uint64(31))


#: The chances of a Poisson number of mean 1 to be 0, at most 1, and so on.
DRAWS = np.cumsum([np.exp(-1) / factorial(i) for i in range(18)])


def counts(m: Booster, h: np.ndarray, fold: np.ndarray, round_: int) -> np.ndarray:
    """How often a round of a model sees each row."""
    seen = fold != (-1 if m.fold is None else m.fold)
    return np.where(seen, _drawn(h, round_, m.sample) if m.bag is None else np.searchsorted(DRAWS, _digest(h, m.bag) / 2.0**64, "right"), 0)


def best_split(sums: np.ndarray, least: int) -> list[float]:
    """Of sums (feature, bin, [rows, weight, gradient, curvature]): place of the feature (-1: none), bin, the squared error
    that the split takes away, the left half's sums and the node's. Ties go to the first feature and bin."""
    left = sums.cumsum(1)
    total = left[0, -1]
    left = left[:, :-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 2] ** 2 / left[..., 1] + right[..., 2] ** 2 / right[..., 1] - total[2] ** 2 / total[1]
    gain[(left[..., 0] < least) | (right[..., 0] < least) | ~np.isfinite(gain)] = -1
    most = gain.max()
    f, b = np.unravel_index((gain >= most * (1 - TIED) if most > 0 else gain == most).argmax(), gain.shape)
    if gain[f, b] <= 1e-10 * max(total[1], 1e-300):
        return [-1, 0, 0, *[0.0] * 4, *total]
    return [f, b, gain[f, b], *left[f, b], *total]


class _Grower:
    """A tree of one model while it grows. Node n has the halves 2 n and 2 n + 1, the root is 1."""

    def __init__(self, model: Booster):
        self.model, self.known, self.drawn = model, {}, {}

    def step(self) -> tuple[list[int], list[int]]:
        """The nodes that are split, best first, by all that is known, and the nodes that must be looked at before this is sure.

        A node that is not looked at yet counts as one that cannot be split. One more look can only put others before a
        node of the final tree's, so its parent is always among those split here: passes are no more than levels.
        """
        if 1 not in self.known:
            return [], [1]
        m, heap, split, wanted = self.model, [], [], []
        whole = self.known[1][8]
        least = max(m.split, 2 * m.leaf)

        def offer(n):
            r = self.known[n]
            if r[0] >= 0 and r[7] >= least and n.bit_length() - 1 < (m.depth or DEEPEST) and r[2] >= m.gain * whole:
                heappush(heap, (-r[2], n))

        offer(1)
        while heap and len(split) < (m.leaves or MOST_LEAVES) - 1:
            n = heappop(heap)[1]
            split.append(n)
            r = self.known[n]
            for child, rows in ((2 * n, r[3]), (2 * n + 1, r[7] - r[3])):
                if child in self.known:
                    offer(child)
                elif rows >= least and child.bit_length() - 1 < (m.depth or DEEPEST):
                    wanted.append(child)
        return split, wanted

    def rows(self, n: int, whole: float) -> float:
        """Of a node whose parent is split; about as many as `whole` of the root."""
        if n == 1:
            return whole
        r = self.known[n // 2]
        return r[7] - r[3] if n % 2 else r[3]

    def look(self, found: dict[int, list[float]]) -> None:
        for n, r in found.items():
            self.known[n] = [int(self.drawn[n][int(r[0])]) if r[0] >= 0 else -1, *r[1:]]

    def tree(self, split: list[int]) -> tuple[Tree, dict[int, int]]:
        """The tree that splits these nodes, and the number of each of its nodes."""
        number, order = {1: 0}, [1]
        cut = set(split)
        for n in order:
            if n in cut:
                for child in (2 * n, 2 * n + 1):
                    number[child] = len(order)
                    order.append(child)
        t = Tree(np.full(len(order), -1), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(len(order)))
        for n, i in number.items():
            if n in cut:
                t.feature[i], t.bin[i], t.left[i] = self.known[n][0], self.known[n][1], number[2 * n]
            elif n > 1:
                r = self.known[n // 2]
                s = np.subtract(r[7:11], r[3:7]) if n % 2 else r[3:7]
                t.value[i] = self.model.rate * s[2] / s[3] if s[3] > 1e-150 else 0.0
            elif n in self.known and self.known[n][10] > 1e-150:
                t.value[i] = self.model.rate * self.known[n][9] / self.known[n][10]
        return t, number


def histogram(x: np.ndarray, s: np.ndarray, bins: int) -> np.ndarray:
    """(feature, bin, [rows, weight, gradient, curvature]) of rows of bins and of their four numbers."""
    k = x.shape[1]
    if len(x) >= LONG:  # the same sums, without an array of rows times features
        return np.stack([[np.bincount(own, v, bins) for v in s.T] for own in map(np.ndarray.astype, x.T, [np.intp] * k)]).transpose(0, 2, 1)
    places = (x + np.arange(0, k * bins, bins)).ravel()
    return np.stack([np.bincount(places, np.repeat(v, k), k * bins) for v in s.T], 1).reshape(k, bins, 4)


def grown_below(x: np.ndarray, s: np.ndarray, node: int, m: Booster, whole: float | None, seeds: list[int], bins: int) -> dict[int, list[float]]:
    """node -> what best_split says (with the feature's own number) of it and of all below it that the tree can need.

    Best first, as the whole tree is grown: its splits below this node are the first ones here. whole: the root's weight.
    """
    known, heap, least, left = {}, [], max(m.split, 2 * m.leaf), (m.leaves or MOST_LEAVES) - 1

    def look(n, rows):
        nonlocal whole
        drawn = _features(x.shape[1], m.features, [*seeds, n])
        own = x[rows] if m.features is None else x[np.ix_(rows, drawn)]
        r = best_split(histogram(own, s[rows], bins), m.leaf)
        whole = r[8] if whole is None else whole
        known[n] = [int(drawn[int(r[0])]) if r[0] >= 0 else -1, *map(float, r[1:])]
        if r[0] >= 0 and r[7] >= least and n.bit_length() - 1 < (m.depth or DEEPEST) and r[2] >= m.gain * whole:
            heappush(heap, (-known[n][2], n, rows))

    look(node, np.arange(len(x)))
    while heap and left > 0:
        _, n, rows = heappop(heap)
        left -= 1
        r = known[n]
        to_left = x[rows, r[0]] <= r[1]
        for child, own, count in ((2 * n, rows[to_left], r[3]), (2 * n + 1, rows[~to_left], r[7] - r[3])):
            if count >= least and child.bit_length() - 1 < (m.depth or DEEPEST):
                look(child, own)
    return known


def grown_levels(x: np.ndarray, s: np.ndarray, node: int, m: Booster, whole: float | None, seeds: list[int], bins: int, even: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and what grown_below says of each, a row a node: level by level, the small nodes of a level at once.

    It goes on where a bound of leaves would end grown_below; its first splits are the same. Rows of small nodes are sorted
    by node and bin, feature by feature, so their sums are running ones and no node has a table of bins. even: every
    chance is a half, so nodes of one label alone are ends and are not looked at.
    """
    least, few, width = max(m.split, 2 * m.leaf), m.features is not None, x.shape[1]
    told, rows, sizes, nodes = [], np.arange(len(x)), np.array([len(x)]), np.array([node])
    while len(nodes):
        drawn = _draws(width, seeds, nodes) if few else None
        found, first = np.zeros((len(nodes), 11)), np.append(0, np.cumsum(sizes))
        large = np.flatnonzero(sizes >= SORTED)
        for i in large:
            own, fs = rows[first[i] : first[i + 1]], drawn[i] if few else None
            r = best_split(histogram(x[own] if fs is None else x[np.ix_(own, fs)], s[own], bins), m.leaf)
            found[i] = [r[0] if fs is None or r[0] < 0 else fs[int(r[0])], *r[1:]]
        for part in _chunks(np.flatnonzero(sizes < SORTED), sizes, SORTED_AT_ONCE // (drawn.shape[1] if few else width)):
            own = rows[np.repeat(first[part] - np.append(0, np.cumsum(sizes[part]))[:-1], sizes[part]) + np.arange(sizes[part].sum())]
            found[part] = _sorted_splits(x[own], s[own], sizes[part], drawn[part] if few else None, m.leaf, bins)
        whole = found[0, 8] if whole is None else whole
        told.append((nodes, found))
        level = int(nodes[0]).bit_length() - 1
        splits = (found[:, 0] >= 0) & (found[:, 7] >= least) & (level < (m.depth or DEEPEST)) & (found[:, 2] >= m.gain * whole)
        at = np.repeat(np.arange(len(nodes)), sizes)
        right = x[rows, np.maximum(found[at, 0], 0).astype(np.intp)] > found[at, 1]
        # the halves of the nodes that are split: those with few rows, or at the depth's end, are not looked at
        halves = np.stack([found[:, 3:7], found[:, 7:11] - found[:, 3:7]], 1)
        looked = splits[:, None] & (halves[:, :, 0] >= least) & (level + 1 < (m.depth or DEEPEST))
        if even:
            looked &= np.abs(np.abs(halves[:, :, 2]) - halves[:, :, 1] / 2) > 1e-12 * halves[:, :, 1]
        number = 2 * at + right
        keep = looked.ravel()[number]
        rows, number = rows[keep], number[keep]
        rows = rows[np.argsort(number, kind="stable")]
        sizes = np.bincount(number, minlength=looked.size)[looked.ravel()]
        nodes = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel()[looked.ravel()]
    return np.concatenate([n for n, _ in told]), np.concatenate([r for _, r in told])


def _chunks(at: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Places in parts of up to about `most` rows."""
    part = np.cumsum(sizes[at]) // max(1, most)
    return np.split(at, np.flatnonzero(np.diff(part)) + 1) if len(at) else []


def _sorted_splits(x: np.ndarray, s: np.ndarray, sizes: np.ndarray, drawn: np.ndarray | None, leaf: int, bins: int) -> np.ndarray:
    """What best_split says of each of some nodes, whose rows stand one after the other; features by their own numbers."""
    n, k = len(x), len(sizes)
    at, starts = np.repeat(np.arange(k), sizes), np.cumsum(sizes) - sizes
    row, bin_ = max(1, int(n - 1).bit_length()), max(1, int(bins - 1).bit_length())
    kind = np.uint32 if row + bin_ + int(k).bit_length() <= 32 else np.uint64
    values = np.ascontiguousarray((x if drawn is None else np.take_along_axis(x, drawn[at], 1)).T).astype(kind)
    values <<= kind(row)
    values |= ((at.astype(kind) << kind(bin_ + row)) | np.arange(n, dtype=kind))[None, :]
    values.sort(axis=1)
    of = (values & kind((1 << row) - 1)).astype(np.intp)
    values >>= kind(row)
    total = np.add.reduceat(s, starts, 0)

    def left(c):
        sums = np.cumsum(s[:, c][of], 1)
        return sums - np.repeat(np.concatenate([np.zeros((len(sums), 1)), sums[:, starts[1:] - 1]], 1), sizes, 1)

    u, g = left(1), left(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / u + (total[at, 2] - g) ** 2 / (total[at, 1] - u) - (total[:, 2] ** 2 / total[:, 1])[at]
    ends = np.append(at[1:] != at[:-1], True)
    bad = ~np.isfinite(gain) | ends
    bad[:, :-1] |= values[:, 1:] == values[:, :-1]
    if leaf > 1:
        rows = left(0)
        bad |= (rows < leaf) | (total[at, 0] - rows < leaf)
    gain[bad] = -1
    best = np.maximum.reduceat(gain, starts, 1)
    most = best.max(0)
    tied = np.where(most > 0, most * (1 - TIED), most)
    f = (best >= tied).argmax(0)
    best = best[f, np.arange(k)]
    own = gain[f[at], np.arange(n)] >= tied[at]
    place = np.minimum.reduceat(np.where(own, np.arange(n), n), starts)
    b = (values[f, place] & kind((1 << bin_) - 1)).astype(np.int64)
    f = f if drawn is None else drawn[np.arange(k), f]
    halves = np.add.reduceat(s * (x[np.arange(n), f[at]] <= b[at])[:, None], starts, 0)
    out = np.concatenate([f[:, None], b[:, None], best[:, None], halves, total], 1)
    none = best <= 1e-10 * np.maximum(total[:, 1], 1e-300)
    out[none, 0] = -1
    out[none, 1:7] = 0
    return out


def _read(b, width: int):
    """bins, label, weight, fold, digest, margins of an Arrow batch."""
    n = b.num_rows
    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(n, width)
    margins = b.column("m").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return bins, *[b.column(c).to_numpy() for c in ("y", "w", "fold", "h")], margins


def numbers(n: np.ndarray, y: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows, weight, gradient and curvature of rows that are seen n times."""
    u = n * w
    return np.stack([n, u, u * (y - p), u * p * (1 - p)], 1)


def _finished(rows: DataFrame, width: int, bins: int, models: list[Booster], late: list[list[Tree]], grown: dict[int, tuple[Tree, dict[int, tuple[int, int]]]], wholes: dict[int, float | None], seed: int, round_: int) -> dict[int, dict[int, list[float]]]:
    """model -> what grown_below says of small nodes. grown: model -> its tree so far, node's number there -> (key, node)."""
    named = {key: (i, n) for i, (_, nodes) in grown.items() for key, n in nodes.values()}

    def sent(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x, y, w, fold, h, margins = _read(b, width)
            for i, (tree, nodes) in grown.items():
                times = counts(models[i], h, fold, round_)
                seen = np.flatnonzero(times)
                at = tree.reached(x[seen])
                out = []
                for node, (key, _) in nodes.items():
                    own = seen[at == node]
                    if len(own):
                        p = _chance(margins[own, i] + sum((t.value[t.reached(x[own])] for t in late[i]), np.zeros(len(own))))
                        out.append((key, x[own].tobytes(), numbers(times[own], y[own], w[own], p).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["key", "x", "s"])

    def below(table):
        import pyarrow as pa

        key = table.column("key")[0].as_py()
        i, n = named[key]
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(-1, width)
        s = np.frombuffer(b"".join(table.column("s").to_pylist())).reshape(-1, 4)
        known = grown_below(x, s, n, models[i], wholes[i], [seed, round_], bins)
        return pa.table({"key": pa.array([key], pa.int64()), "nodes": pa.array([np.array(list(known), np.int64).tobytes()], pa.binary()), "v": pa.array([np.array(list(known.values())).tobytes()], pa.binary())})

    parts = rows.mapInArrow(sent, "key long, x binary, s binary").repartition(min(len(named), 64), "key")
    out: dict[int, dict[int, list[float]]] = {}
    for r in parts.groupBy("key").applyInArrow(below, "key long, nodes binary, v binary").collect():
        values = np.frombuffer(r["v"]).reshape(-1, 11).tolist()
        out.setdefault(named[r["key"]][0], {}).update((n, [int(v[0]), *v[1:]]) for n, v in zip(np.frombuffer(r["nodes"], np.int64).tolist(), values, strict=True))
    for i, n in named.values():
        out.setdefault(i, {}).setdefault(n, [-1, *[0.0] * 10])
    return out


def _passed(rows: DataFrame, width: int, bins: int, models: list[Booster], late: list[list[Tree]], grown: dict[int, tuple[Tree, dict[int, tuple[int, int, np.ndarray]]]], round_: int, judged: set[int], tasks: int = 2) -> dict[int, list[float]]:
    """key -> what best_split says of each node in grown (model -> its tree so far, node's number there -> (key, rows of a
    leaf, features)); judged: -1 - model -> weight, loss and right weight of its fold."""

    def told(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}

        def add(key, v):
            held[key] = held[key] + v if key in held else v

        for b in batches:
            if not b.num_rows:
                continue
            x, y, w, fold, h, margins = _read(b, width)
            for i, m in enumerate(models):
                if i not in grown and i not in judged:
                    continue
                margin = margins[:, i % margins.shape[1]] + sum((t.value[t.reached(x)] for t in late[i]), np.zeros(len(x)))
                p = _chance(margin)
                if i in judged and (on := fold == m.fold).any():
                    loss = np.logaddexp(0, margin[on]) - y[on] * margin[on]
                    add(-1 - i, np.array([w[on].sum(), (w[on] * loss).sum(), w[on][(p[on] > 0.5) == (y[on] > 0.5)].sum()]))
                if i not in grown:
                    continue
                tree, nodes = grown[i]
                times = counts(m, h, fold, round_)
                seen = np.flatnonzero(times)
                at = tree.reached(x[seen])
                order = np.argsort(at, kind="stable")
                seen, at = seen[order], at[order]
                for node, (key, _, features) in nodes.items():
                    own = seen[np.searchsorted(at, node) : np.searchsorted(at, node, "right")]
                    if not len(own):
                        continue
                    add(key, histogram(x[own] if len(features) == width else x[np.ix_(own, features)], numbers(times[own], y[own], w[own], p[own]), bins).ravel())
        for key, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["key", "sums"])

    leaf = {key: least for _, nodes in grown.values() for key, least, _ in nodes.values()}

    def decided(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(v)
                held[key] = held[key] + own if key in held else own
        for key, v in held.items():
            out = v.tolist() if key < 0 else [float(z) for z in best_split(v.reshape(-1, bins, 4), leaf[key])]
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([out], pa.list_(pa.float64()))], ["key", "v"])

    sums = rows.mapInArrow(told, "key long, sums binary")
    sums = sums.repartition(min(len(leaf) + len(judged), 64), "key") if tasks > 1 else sums  # a task that has all rows has whole sums
    return {r["key"]: list(r["v"]) for r in sums.mapInArrow(decided, "key long, v array<double>").collect()}


def fit(df: DataFrame, columns: list[str], models: list[Booster], key: str, label: str = "label", fold: str | None = None, weight: str | None = None, bins: int = BINS, seed: int = 0, edges: np.ndarray | None = None, apart: bool = False, trees: bool = True) -> list[Boosted]:
    """Each model, fitted to rows of label 0 or 1; rows without a label, or whose weight is null or 0, take no part.
    apart: of up to SMALL * MORE rows, a task fits a model, all its rounds; of more rows, and else, passes are shared.
    trees: whether models that are fitted so are wanted with their trees, or only how their folds were judged.

    fold: a column of whole numbers from 0 that the models' folds name. Missing features are a bin of their own, below
    all others. Which rows a round sees is told by a digest of the key, so equal keys go together, and features are drawn
    by round and node: the same on every run. Without rows every margin is 0.
    """
    given, x = None, columns_array(columns)
    if edges is None:
        given = df = written(df.select(x.alias("x"), *dict.fromkeys([key, label, *filter(None, [fold, weight])])), "given")  # read by edges and bins
        edges, x = array_edges(df.filter(F.col(label).isNotNull()), len(columns), bins), F.col("x")
    base, tasks = _prepared(df, x, edges, key, label, fold, weight, len(models))
    if given is not None:
        drop_table(given)
    folds = {r["fold"]: (r["w"], r["s"], r["n"]) for r in base.groupBy("fold").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"), F.count("*").alias("n")).collect()}
    out, sizes = [], []
    for m in models:
        w, s, n = np.sum([v for f, v in folds.items() if m.fold is None or f != m.fold] or [(0.0, 0.0, 0)], 0)
        sizes.append(n * min(m.sample, 1.0))
        out.append(Boosted(columns, edges, float(np.log(s / (w - s))) if 0 < s < w else 0.0 if not w else 10.0 if s else -10.0))
    n = sum(int(v) for _, _, v in folds.values())
    if apart and models and n <= SMALL * MORE:
        for o, (grown, loss, accuracy) in zip(out, _apart(base, n, len(columns), bins, models, [o.base for o in out], seed, trees), strict=True):
            o.trees, o.loss, o.accuracy = grown, loss, accuracy
        drop_table(base)
        return out
    rows, late, width = _moved(_kept_path(base.repartition(tasks), base), len(columns), [[] for _ in models], [o.base for o in out], tasks), [[] for _ in models], len(columns)
    drop_table(base)
    live, pool = list(range(len(models))), ThreadPoolExecutor(1)
    for round_ in range(max((m.rounds for m in models), default=0) + 1):
        growers = {i: _Grower(models[i]) for i in live if round_ < models[i].rounds}
        judged = {i for i in live if models[i].fold is not None}
        done: dict[int, Tree] = {}
        beside = None
        while True:
            wanted = []
            for i in [i for i in growers if i not in done]:
                split, open_ = growers[i].step()
                tree, number = growers[i].tree(split)
                if not open_:
                    done[i] = tree
                wanted += [(i, n, tree, number[n]) for n in open_]
            if not wanted and not judged:
                break
            small = [e for e in wanted if growers[e[0]].rows(e[1], sizes[e[0]]) <= _small(models[e[0]])]
            wanted = [e for e in wanted if growers[e[0]].rows(e[1], sizes[e[0]]) > _small(models[e[0]])]
            if small and judged and not wanted:  # the folds are judged meanwhile
                beside = pool.submit(inheritable_thread_target(df.sparkSession)(_passed), rows, width, bins, models, late, {}, round_, judged, tasks)
            if small:
                grown = {}
                for k, (i, n, tree, number) in enumerate(small):
                    grown.setdefault(i, (tree, {}))[1][number] = (k, n)
                wholes = {i: growers[i].known[1][8] if 1 in growers[i].known else None for i in grown}
                for i, known in _finished(rows, width, bins, models, late, grown, wholes, seed, round_).items():
                    growers[i].known.update(known)
            for part in _portions(wanted, width, bins, models) or [[]] * bool(judged):
                grown, names = {}, {}
                for k, (i, n, tree, number) in enumerate(part):
                    g = growers[i]
                    g.drawn[n] = _features(width, models[i].features, [seed, round_, n])
                    grown.setdefault(i, (tree, {}))[1][number] = (k, models[i].leaf, g.drawn[n])
                    names[k] = i, n
                found = beside.result() if beside else _passed(rows, width, bins, models, late, grown, round_, judged, tasks)
                beside = None
                for i in judged:
                    if -1 - i in found:
                        w, loss, right = found[-1 - i]
                        out[i].loss.append(loss / w)
                        out[i].accuracy.append(right / w)
                judged = set()
                for k, (i, n) in names.items():
                    growers[i].look({n: found.get(k, [-1, *[0.0] * 10])})
        for i, tree in done.items():
            out[i].trees.append(tree)
            late[i].append(tree)
        live = [i for i in live if round_ < models[i].rounds and not _settled(out[i].loss, models[i].patience)]
        if not live:
            break
        if max(map(len, late)) >= EVERY or sum(len(t.feature) for trees in late for t in trees) >= LATE:
            rows, old = _moved(rows, width, late, None, tasks), rows
            drop_table(old)
            late = [[] for _ in models]
    pool.shutdown()
    drop_table(rows)
    return out


def _apart(rows: DataFrame, n: int, width: int, bins: int, models: list[Booster], base: list[float], seed: int, trees: bool) -> list[tuple[list[Tree], list[float], list[float]]]:
    """Trees (if they are asked for), loss and accuracy of each model. The n rows, no more than a small node of few leaves has,
    are read by a task for each model, which grows its trees as passes would: no round is a job."""
    path, order = rows.written_to, sorted(range(len(models)), key=lambda i: (models[i].features is not None, -(models[i].depth or DEEPEST), -models[i].sample))

    def run(batches):
        import pyarrow as pa

        for i in [order[k] for b in batches for k in b.column(0).to_pylist()]:
            grown, loss, accuracy = _rounds(*whole(path, n, width), models[i], base[i], seed, bins)
            parts = [[np.asarray(getattr(t, c), kind).tobytes() for t in grown if trees] for c, kind in KINDS.items()]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *[pa.array([p], pa.list_(pa.binary())) for p in parts], *[pa.array([v], pa.list_(pa.float64())) for v in (loss, accuracy)]], ["i", *KINDS, "loss", "accuracy"])

    each = rows.sparkSession.range(0, len(models), 1, max(1, len(models))).mapInArrow(run, "i long, " + ", ".join(f"{c} array<binary>" for c in KINDS) + ", loss array<double>, accuracy array<double>")
    found = {r["i"]: r for r in each.collect()}
    told = [found[i] for i in range(len(models))]
    return [([Tree(*[np.frombuffer(v, kind) for v, kind in zip(t, KINDS.values(), strict=True)]) for t in zip(*[r[c] for c in KINDS], strict=True)], list(r["loss"]), list(r["accuracy"])) for r in told]


#: A tree's columns as they are sent.
KINDS = {"feature": np.int16, "bin": np.uint8, "left": np.int32, "value": np.float64}


def whole(path: str, n: int, width: int, columns: tuple[str, ...] = ("y", "w", "fold", "h")) -> tuple[np.ndarray, ...]:
    """bins and columns of the n rows that _prepared has written, read from the shared folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs as pafs

    fs, at = pafs.FileSystem.from_uri(path)
    kinds = {"fold": np.int32, "h": np.int64, "id": np.int64}
    x, more, done = np.zeros((n, width), np.uint8), {c: np.zeros(n, kinds.get(c, np.float64)) for c in columns}, 0
    for b in ds.dataset(at, filesystem=fs, format="parquet").to_batches(columns=["bins", *columns]):
        x[done : done + b.num_rows] = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, width)
        for c, v in more.items():
            v[done : done + b.num_rows] = b.column(c).to_numpy()
        done += b.num_rows
    return x, *more.values()


def _rounds(x: np.ndarray, y: np.ndarray, w: np.ndarray, fold: np.ndarray, h: np.ndarray, m: Booster, base: float, seed: int, bins: int) -> tuple[list[Tree], list[float], list[float]]:
    """The trees of a model, and the loss and accuracy of its fold by their number, none first."""
    margin, trees, loss, accuracy = np.full(len(y), base), [], [], []
    on = np.zeros(len(y), bool) if m.fold is None else fold == m.fold
    for round_ in range(m.rounds + 1):
        p = _chance(margin)
        if on.any():
            total = w[on].sum()
            loss.append(float((w[on] * (np.logaddexp(0, margin[on]) - y[on] * margin[on])).sum() / total))
            accuracy.append(float(w[on][(p[on] > 0.5) == (y[on] > 0.5)].sum() / total))
        if round_ == m.rounds:
            break
        times = counts(m, h, fold, round_)
        seen, grower = np.flatnonzero(times), _Grower(m)
        if len(seen):
            own = x[seen], numbers(times[seen], y[seen], w[seen], p[seen])
            if m.leaves is None:
                grower.known = {n: [int(r[0]), *r[1:]] for n, r in zip(*[v.tolist() for v in grown_levels(*own, 1, m, None, [seed, round_], bins)], strict=True)}
            else:
                grower.known = grown_below(*own, 1, m, None, [seed, round_], bins)
        trees.append(grower.tree(grower.step()[0])[0])
        if _settled(loss, m.patience):
            break
        margin += trees[-1].value[trees[-1].reached(x)]
    return trees, loss, accuracy


def _small(m: Booster) -> int:
    """Rows of a node of this model's trees that one task may grow."""
    return SMALL * MORE if m.leaves is not None and m.leaves <= FEW else SMALL


def _settled(loss: list[float], patience: int | None) -> bool:
    """Whether none of the last `patience` losses is below all before."""
    return patience is not None and len(loss) > patience and min(loss[-patience:]) >= min(loss[:-patience])


def _features(width: int, how: str | None, seeds: list[int]) -> np.ndarray:
    return np.arange(width) if how is None else _draws(width, seeds[:-1], np.array(seeds[-1:]))[0]


def _draws(width: int, seeds: list[int], nodes: np.ndarray) -> np.ndarray:
    """A row of as many features as the square root of all (upwards, as Spark's trees), in order, for each node: those whose
    digests are lowest."""
    base = 0
    for v in seeds:
        base = (base ^ (int(v) + 1)) * 0xBF58476D1CE4E5B9 % 2**64
        base ^= base >> 29
    own = _digest(nodes.astype(np.int64) ^ np.int64(base >> 1), 0)
    each = _digest(own.view(np.int64)[:, None] ^ np.arange(1, width + 1)[None, :] * np.int64(0x1E3779B97F4A7C15 >> 8), 1)
    return np.sort(np.argsort(each, 1, kind="stable")[:, : ceil(width**0.5)], 1)


def _portions(wanted: list, width: int, bins: int, models: list[Booster]) -> list[list]:
    """Nodes in parts whose sums take no more than HELD numbers in a task, one node at least."""
    parts, room = [], 0
    for each in wanted:
        size = 4 * bins * (width if models[each[0]].features is None else ceil(width**0.5))
        if not parts or size > room:
            parts.append([])
            room = HELD
        parts[-1].append(each)
        room -= size
    return parts


def columns_array(columns: list[str]) -> Column:
    """Columns of numbers as an array; NaN stands for null."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in columns])


def _prepared(df: DataFrame, x: Column, edges: np.ndarray, key: str, label: str, fold: str | None, weight: str | None, n: int) -> tuple[DataFrame, int]:
    """h, y, w, fold, bins, m of the rows that take part, written; and how many tasks they are worth."""
    one = F.lit(1.0) if weight is None else F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0))
    rows = df.filter(F.col(label).isNotNull()).select(
        F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"), F.col(f"`{label}`").cast("double").alias("y"), one.alias("w"),
        F.lit(-2).alias("fold") if fold is None else F.coalesce(F.col(f"`{fold}`").cast("int"), F.lit(-2)).alias("fold"),
        x.alias("x"),
    ).filter("w > 0")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = binned(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), edges)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("h", "y", "w", "fold")], pa.array([r.tobytes() for r in x], pa.binary())], ["h", "y", "w", "fold", "bins"])

    made = written(rows.mapInArrow(run, "h long, y double, w double, fold int, bins binary"), "binned")
    tasks = made.count() * len(edges) // TASK + 1
    return _kept_path(made.withColumn("m", F.array_repeat(F.lit(0.0), n)), made), tasks


def _kept_path(df: DataFrame, of: DataFrame) -> DataFrame:
    df.written_to = of.written_to
    return df


def _moved(rows: DataFrame, width: int, late: list[list[Tree]], base: list[float] | None, tasks: int) -> DataFrame:
    """rows with margins that hold these trees, or start from base, written."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x, *_, margins = _read(b, width)
            moved = margins.copy() if base is None else np.tile(np.array(base), (len(x), 1))
            for i, trees in enumerate(late):
                for t in trees:
                    moved[:, i] += t.value[t.reached(x)]
            offsets = pa.array(np.arange(len(x) + 1) * moved.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("h", "y", "w", "fold", "bins")], pa.ListArray.from_arrays(offsets, pa.array(moved.ravel()))], ["h", "y", "w", "fold", "bins", "m"])

    made = written(rows.mapInArrow(run, "h long, y double, w double, fold int, bins binary, m array<double>"), "margins")
    return _kept_path(made.coalesce(tasks), made)


def search(train: DataFrame, columns: list[str], points: list[dict], key: str, label: str = "label", fold: str = "fold", folds: int = 2, **parameters) -> tuple[dict, Boosted, list[float]]:
    """The best point, its model refitted on all of train, and every point's mean accuracy over the folds; ties go to the earlier point.
    A fold without rows has no say.

    Points are rows of a grid of boosted trees (rate, depth, features, leaves, gain, leaf, split, trees, sample, warm).
    Those that differ in `trees` alone are one fit, of which each number of trees is a prefix; a warm start from a
    prefix is the same model, so `warm` changes nothing. All folds of all points are fitted in the same passes.
    train is written once, its key, label, fold and columns (and the weight's).
    """
    rounds = [p["trees"] for p in points]
    alike: dict[Booster, int] = {}
    for p, n in zip(points, rounds, strict=True):
        alike[_booster(p)] = max(n, alike.get(_booster(p), 0))
    models = [replace(m, rounds=n, fold=f) for m, n in alike.items() for f in range(folds)]
    train = written(train.select(*dict.fromkeys([key, label, fold, *columns, *filter(None, [parameters.get("weight")])])), "train")  # read by edges and both fits
    edges = column_edges(train.filter(F.col(label).isNotNull()), columns)
    made = dict(zip([(replace(m, rounds=0, fold=None), m.fold) for m in models], fit(train, columns, models, key, label, fold, edges=edges, apart=True, trees=False, **parameters), strict=True))
    told = [[a[n] for f in range(folds) if (a := made[_booster(p), f].accuracy)] for p, n in zip(points, rounds, strict=True)]
    scores = [float(np.mean(a)) if a else 0.0 for a in told]
    best = int(np.argmax(scores))
    model = fit(train, columns, [replace(_booster(points[best]), rounds=rounds[best])], key, label, edges=edges, apart=True, **parameters)[0]
    drop_table(train)
    return points[best], model, scores


def _booster(point: dict) -> Booster:
    return Booster(rounds=0, **{k: v for k, v in point.items() if k not in ("trees", "warm")})
