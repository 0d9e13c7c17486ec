"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are integers. A block of candidates is indexed once as posting segments: by descending quantised impact |v|,
the postings (candidate, dimension, value) of that range and no others. For a block of queries, segments are added to
the scores one after the other. After a segment every candidate has an upper bound: its score so far, and the query's
length times that of what the candidate has in later segments. A query's floor is the k-th score that is known to be
reached. A query stops only when few candidates can still reach its floor; the segments left are skipped and these
candidates are rescored exactly. The last segment completes all scores, so a query that never stops is exact as well.

Only postings are touched: a segment's lists, one for each dimension and some hundred candidates, are added for all
queries at once, so that the scores they add to stay in a core's cache.

Over blocks, candidates are searched in rounds that grow eightfold. A round's floors are the k-th scores of all rounds
before, so a block reports only what may still enter a result: some 8 k rows a query and round, however many blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.llm import store
from quillmatch.llm.common import drop_table, written

#: Rows of a block of candidates, which is also the first round, and of a block of queries; growth of the rounds.
CANDIDATES, QUERIES, GROWTH = 16_384, 256, 8

#: Candidates whose postings of a dimension are one list.
LISTED = 512

#: Queries of up to so many bytes stay in a task's memory; more are read anew for each block of candidates.
HELD = 64 << 20


def _numbers(a: np.ndarray, b: np.ndarray):
    """A type in which every sum of products is exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


def edges_of(impacts: np.ndarray, parts: int = 4) -> list[int]:
    """Descending lower edges of the impact ranges, about as many postings in each; the last is 1."""
    some = impacts[impacts > 0]
    cuts = {int(x) for x in np.quantile(some, np.arange(1, parts) / parts)} if some.size else set()
    return [*sorted(cuts - {0, 1}, reverse=True), 1]


class Index:
    """Posting segments of a block of candidates; visited counts the postings that searches have added up."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.v, self.ids, self.visited = vectors, ids, 0
        impact = np.abs(vectors)
        square, above = (vectors.astype(float) ** 2), None
        self.segments, self.postings = [], int((impact > 0).sum())
        for edge in edges_of(impact):
            inside = impact >= edge if above is None else (impact >= edge) & (impact < above)
            rows, dims = np.nonzero(inside)
            lists = rows // LISTED * vectors.shape[1] + dims
            order = np.argsort(lists, kind="stable")
            numbers, starts = np.unique(lists[order], return_index=True)
            rest = np.sqrt(np.where(impact < edge, square, 0).sum(axis=1))
            self.segments.append((rows[order], vectors[rows, dims][order], numbers % max(1, vectors.shape[1]), [*starts.tolist(), len(rows)], rest))
            above = edge

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray | None = None, few: float = 0.1):
        """Per query (query_id, ids, scores) of its k best at or above its floor: score descending, id ascending.

        A query's own id is no candidate. floors: minus infinity for none.
        """
        kind, n = _numbers(self.v, queries), len(self.ids)
        floors = np.full(len(queries), -np.inf) if floors is None else floors.astype(float)
        order = np.argsort(self.ids, kind="stable")
        at = np.searchsorted(self.ids, query_ids, sorter=order)
        till = np.searchsorted(self.ids, query_ids, side="right", sorter=order)
        own = [order[lo:hi] for lo, hi in zip(at, till, strict=True)]

        def best(i: int, rows: np.ndarray, scores: np.ndarray):
            some = scores >= floors[i]
            rows, scores = rows[some], scores[some]
            if len(rows) > 4 * k:
                some = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                rows, scores = rows[some], scores[some]
            top = np.lexsort((self.ids[rows], -scores))[:k]
            return query_ids[i], self.ids[rows][top], scores[top]

        if kind is object:
            for i, q in enumerate(queries):
                rows = np.setdiff1d(np.arange(n), own[i])
                scored = sorted(((-sum(int(x) * int(y) for x, y in zip(self.v[r], q, strict=True)), self.ids[r]) for r in rows))[:k]
                scored = [(s, j) for s, j in scored if -s >= floors[i]]
                yield query_ids[i], np.array([j for _, j in scored], np.int64), [-s for s, _ in scored]
            return
        v, q = self.v.astype(kind), queries.astype(kind)
        long = np.linalg.norm(queries.astype(float), axis=1)
        acc, alive, seen = np.zeros((n, len(q)), kind), np.arange(len(q)), 0
        for rows, values, dims, starts, rest in self.segments:
            impacts, by_dim = values.astype(kind)[:, None], np.ascontiguousarray(q[alive].T)
            for d, lo, hi in zip(dims, starts, starts[1:], strict=False):
                acc[rows[lo:hi]] += impacts[lo:hi] * by_dim[d]
            seen += len(rows)
            self.visited += len(rows) * len(alive)
            if 3 * seen < self.postings or not rest.any() or n <= 4 * k:
                continue
            # rounding is far below what is added
            upper = acc + ((rest * 1.0001)[:, None] * long[None, alive] + 2).astype(kind)
            so_far = acc.T.copy()
            for j, i in enumerate(alive):
                upper[own[i], j] = so_far[j, own[i]] = -np.inf
            top = np.argpartition(so_far, n - k, axis=1)[:, n - k :]
            exact = np.einsum("ikd,id->ik", v[top], q[alive])
            exact[np.isneginf(np.take_along_axis(so_far, top, 1))] = -np.inf
            floors[alive] = np.maximum(floors[alive], exact.min(axis=1))
            members = (upper >= floors[None, alive]).T
            stop = members.sum(axis=1) <= max(4 * k, few * n)
            for j in np.flatnonzero(stop):
                rows = np.flatnonzero(members[j])
                yield best(alive[j], rows, v[rows] @ q[alive[j]])
            acc, alive = np.ascontiguousarray(acc[:, ~stop]), alive[~stop]
            if not len(alive):
                return
        for j, i in enumerate(alive):
            rows = np.setdiff1d(np.arange(n), own[i]) if len(own[i]) else np.arange(n)
            yield best(i, rows, acc[rows, j])


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists as whole numbers, shorter lists filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))


class _Queries:
    """Blocks (ids, floors, vectors) of a table of queries, read by a task."""

    def __init__(self, folder: str):
        self._folder, self._held = folder, None

    def __iter__(self):
        if self._held is None:
            held, size = [], 0
            for block in self._read():
                yield block
                size += sum(x.nbytes for x in block)
                held = held if held is None or size > HELD else [*held, block]
                held = None if size > HELD else held
            self._held = held if held is not None else False
        else:
            yield from self._held or self._read()

    def _read(self):
        import pyarrow.parquet as pq

        fs, path = store.resolve(self._folder)
        for name, _ in store.files(self._folder, ".parquet"):
            with fs.open_input_file(f"{path}/{name}") as f:
                for b in pq.ParquetFile(f).iter_batches(QUERIES, columns=["vec_id", "floor", "v"]):
                    yield b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(float), _matrix(b.column(2))


def _best_of(vectors: DataFrame, folder: str, k: int, candidates: int) -> DataFrame:
    """query_id, vec_id, score: what blocks of the vectors hold of each query's k best at or above its floor."""

    def run(batches):
        import pyarrow as pa

        queries = _Queries(folder)

        def search(held):
            width = max(m.shape[1] for _, m in held)
            index = Index(np.concatenate([_widened(m, width) for _, m in held]), np.concatenate([i for i, _ in held]))
            for ids, floors, q in queries:
                wide = max(width, q.shape[1])
                index.v = _widened(index.v, wide)
                found = list(index.search(_widened(q, wide), ids, k, np.where(np.isnan(floors), -np.inf, floors)))
                cols = [np.repeat([i for i, _, _ in found], [len(s) for _, _, s in found]), np.concatenate([x for _, x, _ in found]), np.concatenate([np.array([int(y) for y in s], np.int64) for _, _, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["query_id", "vec_id", "score"])

        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, candidates):
                part = b.slice(at, candidates)
                held.append((part.column(0).to_numpy(), _matrix(part.column(1))))
                n += part.num_rows
                if n >= candidates:
                    yield from search(held)
                    held, n = [], 0
        if n:
            yield from search(held)

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, candidates: int = CANDIDATES) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: each query's k highest inner products, ties to smaller ids.

    Both tables: vec_id long, v array<long>. Rows that repeat an id and vector count once, a null id or vector not at
    all. Rows that share an id and differ in the vector are each a candidate; as queries they share the k ranks of
    their id, which go to the k highest scores of all their pairs. A query's own id is no candidate. Shorter vectors
    count as if filled up with zeros. No vectors or no queries: no rows. Other columns are not read.

    Vectors are shuffled once, to find repeated ones, and written; tasks read blocks of them, and the queries from
    files of the shared folder. The result is a table there.
    """
    slim = [t.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<bigint>").alias("v")).dropna().distinct() for t in (vectors, queries)]
    held, asked = written(slim[0], "vectors"), written(slim[1], "queries")
    n, rounds = held.count(), [0.0]
    while candidates * GROWTH ** (len(rounds) - 1) < n:
        rounds.append(candidates * GROWTH ** (len(rounds) - 1) / n)
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rank, best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")), None
    for low, high in zip(rounds, [*rounds[1:], 1.0], strict=True):
        floor = F.lit(None).cast("double")
        ask = asked.withColumn("floor", floor)
        if best is not None:
            known = best.filter(F.col("rank") == k).select(F.col("query_id").alias("__id"), F.col("score").cast("double").alias("floor"))
            ask = asked.join(known, F.col("vec_id") == F.col("__id"), "left").select("vec_id", "v", "floor")
        ask = written(ask, "queries")
        found = _best_of(held.filter((place >= low) & (place < high)).select("vec_id", "v"), ask.written_to, k, candidates)
        found = found if best is None else found.unionByName(best.drop("rank"))
        now = written(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
        for old in (ask, *([best] if best is not None else [])):
            drop_table(old)
        best = now
    drop_table(held)
    drop_table(asked)
    return best


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v array<long> with floor(scale * x), row by row.

    Vectors null or holding null or non-finite components are left out; an empty vector stays. Repeated rows and
    null ids stay. Only vec_id and embedding are read.
    """
    x = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    x = x.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return x.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def search_embeddings(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by `every`, against all rows; nulls, ties and repeats as in search."""
    v = quantised(embeddings)
    return search(v, v.filter(F.col("vec_id") % every == 0), k)
