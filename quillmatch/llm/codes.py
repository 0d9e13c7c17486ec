"""Vector compression by product codes: each part of a vector becomes the number of its nearest codebook entry.

Codebooks grow by rounds of assignment and mean, in whole numbers. The nearest entry is found in a vantage-point tree
over the entries of a part's codebook, searched depth first for a whole batch at a time: a branch is passed over only
if its distance bounds, rounded outwards, lie above the best distance known (not at it, so that ties are seen), and
what is compared in the end are integers. Of a round only sums by entry are shuffled, and only codebooks, whose size is
fixed, reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import joined_by_hot_keys, written

#: Entries of a tree's leaf; rows searched together.
LEAF, ROWS = 16, 4096

#: Scaled components beyond this would not leave room for an error in 64 bits.
LARGEST = 1 << 24


class VantageTree:
    """Nearest entries by squared Euclidean distance in whole numbers, ties to the lower index."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = np.asarray(entries, np.int64), leaf
        self.visited = 0  # rows times entries whose distance was computed
        self.root = self._grown(np.arange(len(self.entries)))

    def _grown(self, own: np.ndarray):
        """(None, members) of a leaf; else (vantage entry, [(least, greatest distance of a branch to it, branch)])."""
        if len(own) <= self.leaf:
            return None, own
        spread = ((self.entries[own] - self.entries[own].mean(axis=0)) ** 2).sum(axis=1)
        at = own[spread.argmax()]
        rest = own[own != at]
        far = np.sqrt(((self.entries[rest] - self.entries[at]) ** 2).sum(axis=1).astype(float))
        order = far.argsort(kind="stable")
        half = len(order) // 2
        sides = [(np.nextafter(far[o].min(), -1.0), np.nextafter(far[o].max(), np.inf), self._grown(rest[o])) for o in (order[:half], order[half:])]
        return at, sides

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        rows = np.asarray(rows, np.int64)
        index, best = np.full(len(rows), len(self.entries), np.int64), np.full(len(rows), np.iinfo(np.int64).max)

        def seen(who: np.ndarray, entries: np.ndarray) -> np.ndarray:
            """Squared distances of the rows to these entries, ascending by index; the best are kept."""
            self.visited += len(who) * len(entries)
            d = ((rows[who][:, None, :] - self.entries[entries][None]) ** 2).sum(axis=2)
            k = d.argmin(axis=1)
            least, i = d[np.arange(len(who)), k], entries[k]
            better = (least < best[who]) | ((least == best[who]) & (i < index[who]))
            best[who[better]], index[who[better]] = least[better], i[better]
            return d

        def visit(node, who: np.ndarray) -> None:
            at, below = node
            if at is None:
                if len(who) and len(below):
                    seen(who, np.sort(below))
                return
            d = np.sqrt(seen(who, np.array([at]))[:, 0].astype(float))
            bounds = [np.maximum(np.maximum(low - d * (1 + 1e-12), d * (1 - 1e-12) - high), 0.0) for low, high, _ in below]
            first = bounds[1] < bounds[0]
            for mine, order in ((~first, (0, 1)), (first, (1, 0))):
                for k in order:
                    near = who[mine]
                    may = bounds[k][mine] * (1 - 1e-12) <= np.sqrt(best[near].astype(float)) * (1 + 1e-12)
                    if may.any():
                        visit(below[k][2], near[may])

        if len(rows):
            visit(self.root, np.arange(len(rows)))
        return index, best


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def whole_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, label, v array<long>: rows whose vector is not null and holds neither null nor a non-finite component."""
    x = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("embedding")).filter(fine)
    return slim.select("vec_id", "label", scaled(F.col("embedding"), scale).alias("v"))


def compress(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code array<int>, error) and the codebooks: a table of the shared folder, and an array a part.

    embeddings: vec_id, embedding, label; other columns are not read. Rows with a null vector, a null or a non-finite
    component are left out. First entries: the parts of the smallest vec_ids (null ones last, equal ones by vector).
    Fewer rows than entries: as many entries as rows. Repeated rows count each. Empty table: no rows, empty codebooks.
    All vectors must have one length, a multiple of parts, and scaled components up to LARGEST: else ValueError.
    """
    v = written(whole_vectors(embeddings, scale), "vectors")
    top = F.array_max(F.transform("v", lambda c: F.abs(c)))
    low, high, most = v.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(top)).first()
    if low != high or (low or 0) % parts or (most or 0) > LARGEST:
        raise ValueError(f"vectors must have one length, a multiple of {parts}, and components up to {LARGEST / scale}")
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, (low or 0) // parts)
    books = [start[:, p].copy() for p in range(parts)]
    for _ in range(rounds if len(first) else 0):
        for p, entry, n, sums in _sums(v, books).collect():
            books[p][entry] = [s // n for s in sums]
    return written(_coded(v, books), "codes"), books


def _parts(column, books: list[np.ndarray]) -> np.ndarray:
    """An Arrow list column as rows x parts x width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(books), -1)


def _sums(v: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, n, sums array<long>: of the parts assigned to each entry that got any; summed in tasks first."""
    width = books[0].shape[1]
    kind = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width))

    def run(batches):
        import pyarrow as pa

        trees = [VantageTree(b) for b in books]
        n, sums = np.zeros((len(books), len(books[0])), np.int64), np.zeros((len(books), *books[0].shape), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = _parts(b.column(0).slice(at, ROWS), books)
                for p, tree in enumerate(trees):
                    index, _ = tree.nearest(x[:, p])
                    n[p] += np.bincount(index, minlength=len(books[p]))
                    np.add.at(sums[p], index, x[:, p])
        p, e = n.nonzero()
        schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), *[(f"s{i}", pa.int64()) for i in range(width)]])
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), *[pa.array(sums[p, e, i]) for i in range(width)]], schema=schema)

    own = v.select("v").mapInArrow(run, kind)
    total = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    return total.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(width)]) if width else F.array().cast("array<long>"))


def _coded(v: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of each row."""

    def run(batches):
        import pyarrow as pa

        trees = [VantageTree(b) for b in books]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x = _parts(part.column(2), books)
                found = [t.nearest(x[:, p]) for p, t in enumerate(trees)]
                code = np.stack([i for i, _ in found], axis=1).astype(np.int32)
                offsets = pa.array(np.arange(len(code) + 1) * len(books), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(code.ravel())), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    kind = f"vec_id long, label {v.schema['label'].dataType.simpleString()}, code array<int>, error long"
    return v.select("vec_id", "label", "v").mapInArrow(run, kind)


def restored(coded: DataFrame, books: list[np.ndarray], scale: int = 1024) -> DataFrame:
    """coded with v array<double>: the vectors that the codes stand for."""
    width = books[0].shape[1]

    def run(batches):
        import pyarrow as pa

        table = np.stack(books)
        for b in batches:
            code = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(books))
            x = table[np.arange(len(books)), code].reshape(b.num_rows, -1) / scale
            offsets = pa.array(np.arange(b.num_rows + 1) * len(books) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["vec_id", "code", "v"])

    return coded.select("vec_id", "code").mapInArrow(run, "vec_id long, code array<int>, v array<double>")


def report(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: codes as hex digits, and the errors summed over equal labels."""
    coded, books = compress(embeddings, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    keyed = coded.withColumns({"none": F.col("label").isNull(), "key": F.coalesce("label", F.lit(0).cast(coded.schema["label"].dataType))})
    sums = keyed.groupBy("none", "key").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    out = joined_by_hot_keys(keyed, sums, ["none", "key"])
    digits = max(2, len(f"{max(0, entries - 1):x}"))
    code = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), digits, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
