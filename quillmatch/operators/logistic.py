"""Many logistic models over the same rows, fitted together: every step of all of them is one pass.

A pass yields each model's gradient, curvature and loss from each task; these are added up on the executors, model by
model, so that what reaches the driver is one small matrix a model, however many tasks there were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Newton steps at most, and the relative change of the objective at which a model is done.
STEPS, TOLERANCE = 60, 1e-9


def summed(partials: DataFrame) -> dict[int, np.ndarray]:
    """model -> the sum of its rows' sums (model long, sums array<double>), added up on the executors."""

    def add(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for b in batches:
            offsets = b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy()
            for i, m in enumerate(b.column(0).to_pylist()):
                own = flat[offsets[i] : offsets[i + 1]]
                held[m] = held[m] + own if m in held else own.copy()
        for m, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["model", "sums"])

    return {r["model"]: np.array(r["sums"]) for r in partials.repartition("model").mapInArrow(add, "model long, sums array<double>").collect()}


def partial_sums(rows: DataFrame, of) -> DataFrame:
    """model, sums: what `of` (x, y, weight, folds of a batch -> {model: array}) adds up to in each task."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            folds = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for m, v in of(x, b.column(1).to_numpy(), b.column(2).to_numpy(), folds).items():
                held[m] = held[m] + v if m in held else v
        for m, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["model", "sums"])

    return rows.select("x", "y", "w", "folds").mapInArrow(run, "model long, sums array<double>")


@dataclass(frozen=True)
class Point:
    """A model: its share of the absolute penalty, its penalty, and the fold of a deal that it does not see (None: it sees all)."""

    mix: float
    penalty: float
    deal: int = 0
    fold: int | None = None

    def seen(self, folds: np.ndarray) -> np.ndarray:
        return np.ones(len(folds), bool) if self.fold is None else folds[:, self.deal] != self.fold


def _spreads(rows: DataFrame, points: list[Point]) -> tuple[np.ndarray, np.ndarray]:
    """Each model's total weight and its columns' weighted deviations, as the rows it sees have them."""
    sets = sorted({(p.deal, -1 if p.fold is None else p.fold) for p in points})
    number = {s: i for i, s in enumerate(sets)}

    def of(x, y, w, folds):
        out = {}
        for (deal, fold), i in number.items():
            on = folds[:, deal] != fold if fold >= 0 else np.ones(len(x), bool)
            own, u = x[on], w[on]
            out[i] = np.concatenate([[u.sum(), (u * u).sum()], own.T @ u, (own * own).T @ u])
        return out

    found = summed(partial_sums(rows, of))
    totals, spreads = [], []
    for p in points:
        s = found[number[p.deal, -1 if p.fold is None else p.fold]]
        total, squares, d = s[0], s[1], (len(s) - 2) // 2
        mean = s[2 : 2 + d] / total
        variance = np.maximum(s[2 + d :] / total - mean * mean, 0.0) * total / max(total - squares / total, 1e-300)
        totals.append(total)
        spreads.append(np.sqrt(np.where(variance > 1e-24 * (1 + mean * mean), variance, 0.0)))
    return np.array(totals), np.array(spreads)


def _newton(h: np.ndarray, g: np.ndarray, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 2000, tolerance: float = 1e-11) -> np.ndarray:
    """Minima of the models' quadratic approximations with their penalties, by coordinate descent of all at once.

    The first coordinate is the intercept. l1 infinite: the coefficient stays 0.
    """
    b, r = beta.copy(), g.copy()  # r: gradient of the quadratic at b
    curve = np.maximum(np.einsum("mii->mi", h), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(b.shape[1]):
            a = curve[:, j] + l2[:, j]
            u = curve[:, j] * b[:, j] - r[:, j]
            new = np.sign(u) * np.maximum(np.abs(u) - l1[:, j], 0.0) / a
            new = np.where(np.isinf(l1[:, j]), 0.0, new)
            step = new - b[:, j]
            if step.any():
                r += h[:, j, :] * step[:, None]
                b[:, j] = new
                moved = max(moved, float((np.abs(step) * np.sqrt(curve[:, j])).max()))
        if moved < tolerance:
            break
    return b


def fits(rows: DataFrame, points: list[Point], start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of each point, the intercept first, by proximal Newton steps.

    rows: x array<double>, y (0 or 1), w and folds array<int>, a fold for each deal. The loss is the weighted mean; the
    penalty is taken on coefficients of columns scaled to a deviation of 1, as Spark does, and not on the intercept. A
    column without spread has a coefficient of 0. A step that does not lower a model's objective is halved.
    """
    totals, spreads = _spreads(rows, points)
    d = spreads.shape[1]
    mix, penalty = np.array([p.mix for p in points])[:, None], np.array([p.penalty for p in points])[:, None]
    l1 = np.concatenate([np.zeros((len(points), 1)), np.where(spreads > 0, mix * penalty * spreads, np.inf)], axis=1)
    l2 = np.concatenate([np.zeros((len(points), 1)), (1 - mix) * penalty * spreads**2], axis=1)
    beta = np.zeros((len(points), d + 1)) if start is None else start.copy()
    last, base, step, open_ = np.full(len(points), np.inf), beta.copy(), np.zeros_like(beta), np.ones(len(points), bool)

    def charge(b):
        return (np.where(np.isinf(l1), 0.0, l1) * np.abs(b) + 0.5 * l2 * b * b).sum(axis=1)

    for _ in range(STEPS):
        now = np.flatnonzero(open_)
        if not len(now):
            break
        given, own = beta[now], [points[i] for i in now]

        def of(x, y, w, folds, given=given, own=own):
            one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            eta, out = one @ given.T, {}
            p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
            loss = np.logaddexp(0, eta) - y[:, None] * eta
            for k, point in enumerate(own):
                u = w * point.seen(folds)
                curve = u * np.maximum(p[:, k] * (1 - p[:, k]), 1e-12)
                out[k] = np.concatenate([[float(u @ loss[:, k])], one.T @ (u * (p[:, k] - y)), ((one * curve[:, None]).T @ one).ravel()])
            return out

        found = summed(partial_sums(rows, of))
        sums = np.array([found[k] for k in range(len(now))]) / totals[now][:, None]
        value = sums[:, 0] + charge(beta)[now]
        worse = value > last[now] + 1e-12 * np.abs(value)
        step[now[worse]] /= 2
        beta[now[worse]] = base[now[worse]] + step[now[worse]]
        good = now[~worse]
        done = last[good] - value[~worse] <= TOLERANCE * np.abs(value[~worse])
        last[good] = value[~worse]
        open_[good[done]] = False
        open_[now[worse & (np.abs(step[now]).max(axis=1) < 1e-10)]] = False
        go = np.flatnonzero(~worse)[~done]
        if len(go):
            at = now[go]
            new = _newton(sums[go, d + 2 :].reshape(-1, d + 1, d + 1), sums[go, 1 : d + 2], beta[at], l1[at], l2[at])
            base[at], step[at] = beta[at], new - beta[at]
            beta[at] = new
    return beta


def held_out_accuracy(rows: DataFrame, points: list[Point], beta: np.ndarray) -> np.ndarray:
    """The share of rows that each model does not see and says right; rows count alike."""

    def of(x, y, w, folds):
        right = ((x @ beta[:, 1:].T + beta[:, 0] > 0) == (y[:, None] > 0.5)).astype(float)
        return {k: np.array([float(right[unseen, k].sum()), float(unseen.sum())]) for k, p in enumerate(points) for unseen in [~p.seen(folds)]}

    found = summed(partial_sums(rows, of))
    return np.array([found[k][0] / max(1.0, found[k][1]) for k in range(len(points))])


def cross_validated(rows: DataFrame, grid: list[tuple[float, float]], folds: int, deals: int) -> np.ndarray:
    """Mean held-out accuracy of each (mix, penalty) over the folds of every deal, all fitted in shared passes.

    Penalties go in falling order, each starting where the one before ended.
    """
    scores = np.zeros(len(grid))
    start: dict[tuple, np.ndarray] = {}
    for penalty in sorted({p for _, p in grid}, reverse=True):
        own = [i for i, (_, p) in enumerate(grid) if p == penalty]
        points = [Point(grid[i][0], penalty, deal, fold) for i in own for deal in range(deals) for fold in range(folds)]
        keys = [(p.mix, p.deal, p.fold) for p in points]
        beta = fits(rows, points, np.array([start[k] for k in keys]) if start else None)
        start = dict(zip(keys, beta, strict=True))
        right = held_out_accuracy(rows, points, beta)
        for n, i in enumerate(own):
            scores[i] = right[n * deals * folds : (n + 1) * deals * folds].mean()
    return scores


def binomial_fits(rows: DataFrame, models: list[list[int]], starts: list, iterations: int = 25, tolerance: float = 1e-8) -> list[tuple]:
    """(coefficients, deviance) of unpenalised models of some columns of x each, all at once by Fisher scoring.

    rows: x array<double>, with the 1 of the intercept, and y.
    """
    beta, dev, open_ = [np.array(s, float) for s in starts], [np.inf] * len(models), set(range(len(models)))
    whole = rows.select("x", "y", F.lit(1.0).alias("w"), F.array(F.lit(0)).alias("folds"))
    for _ in range(iterations):
        if not open_:
            break
        now, given = sorted(open_), {i: beta[i] for i in open_}

        def of(x, y, w, folds, now=now, given=given):
            out = {}
            for i in now:
                own = x[:, models[i]]
                eta = np.clip(own @ given[i], -30, 30)
                p = 1 / (1 + np.exp(-eta))
                u = p * (1 - p)
                loss = float(2 * np.logaddexp(0, np.where(y > 0, -eta, eta)).sum())
                out[i] = np.concatenate([((own * u[:, None]).T @ own).ravel(), own.T @ (u * eta + y - p), [loss]])
            return out

        sums = summed(partial_sums(whole, of))
        for i in now:
            k, s = len(models[i]), sums[i]
            if abs(dev[i] - s[-1]) <= tolerance * (abs(s[-1]) + 0.1):
                open_.discard(i)
            else:
                beta[i] = np.linalg.lstsq(s[: k * k].reshape(k, k), s[k * k : -1], rcond=None)[0]
            dev[i] = s[-1]
    return list(zip(beta, dev, strict=True))
