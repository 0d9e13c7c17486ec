"""Near-duplicate groups: MinHash bands, sequential Bayesian pruning, exact verification, connected components.

1. One pass over the texts: each document's set of word shingles becomes its size, a 128-bit fingerprint and a
   signature of 256 minima. Documents with equal fingerprints have equal sets; one stands for all from here on.
2. Bands of the signature are buckets. In each, one member is paired with every other: the one with the most company
   over all its buckets, which in a family of copies is the text they were made from.
3. Pairs are compared in batches of signature rows; one is pruned as soon as the posterior chance that its similarity
   reaches the threshold falls below the miss probability. Survivors are verified on their full sets.
4. Links give components. In a bucket that still spans several, the members of different components are compared in
   blocks of bounded size, which make a row only of a pair that the same pruning leaves; blocks of the bucket's largest
   component meet only those of the others. Buckets too large for that are first split by further signature rows. No
   bucket is cut short.

A pair at the threshold shares no band with probability (1 - 0.8 ** 4) ** 32, below 1e-7.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import BROADCAST_IDS, drop_table, fresh, joined_by_hot_keys, kept, release, written
from quillmatch.llm.components import components
from quillmatch.llm.wordhash import SPACES, mix, parts, word_hashes

HASHES, BANDS, ROWS, BATCH = 256, 32, 4, 16
#: A bucket of more members is split: into so many sub-bands, at so many levels at most.
SPLIT, SPLITS, LEVELS = 8192, 28, 2
#: Members of a block, and rows of the tiles that one group holds.
BLOCK, BUNDLE = 512, 8192
#: The same, once a row holds a full set.
SETS = 1024
#: The chance of pruning a pair that reaches the threshold, after each batch.
MISS = 1e-6

_RNG = np.random.default_rng(20240229)
#: Odd factors: each is a permutation of 32-bit numbers.
_FACTORS = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: The signature rows of each sub-band of each level.
_SPLIT_ROWS = np.array([[_RNG.choice(HASHES, ROWS, replace=False) for _ in range(SPLITS)] for _ in range(LEVELS)])


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. Fewer words than a shingle has: the whole sequence is one."""
    hashes, n = word_hashes(texts, SPACES)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    if len(hashes) >= words:
        rolled = hashes[: len(hashes) - words + 1].copy()
        for i in range(1, words):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - words + 1 + i]
        rolled = mix(rolled)
    out = []
    for i, m in enumerate(n):
        if m >= words:
            out.append(np.unique(rolled[at[i] : at[i] + m - words + 1]))
        elif m:
            whole = np.uint64(m)
            for h in hashes[at[i] : at[i + 1]].tolist():
                whole = np.uint64((int(whole) * 0x9E3779B97F4A7C15 + h) % 2**64)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(own: np.ndarray, step: int = 4096) -> np.ndarray:
    """256 minima of a set of 64-bit hashes, each hashed to 16 bits."""
    low, out = (own >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(low), step):
        np.minimum(out, (_FACTORS[:, None] * low[None, i : i + step]).min(axis=1), out=out)
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """Two sums over the set, as signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        two = np.array([mix(own).sum(dtype=np.uint64), mix(own * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)], np.uint64)
    return tuple(two.view(np.int64).tolist())


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For n compared rows the fewest matches with which a pair is not pruned.

    Prior of the similarity: uniform. The chance that it reaches t, given m matches of n, is that of at most m
    successes in n + 1 trials of t.
    """
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out[n] = m
                break
    return out


def possible(a: np.ndarray, b: np.ndarray, least: dict[int, int], u: np.ndarray | None = None, v: np.ndarray | None = None) -> np.ndarray:
    """Which pairs (a[u], b[v]) of signatures survive, batch after batch; u and v default to row by row."""
    u, v = (np.arange(len(a)), np.arange(len(b))) if u is None else (u, v)
    alive, matches = np.arange(len(u)), np.zeros(len(u), np.int64)
    for n, m in least.items():
        some = slice(n - BATCH, n)
        matches[alive] += (a[u[alive], some] == b[v[alive], some]).sum(axis=1)
        alive = alive[matches[alive] >= m]
        if not len(alive):
            break
    return alive


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _keys(values: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit keys of (rows, bands, ROWS) values."""
    out = np.broadcast_to(salt, values.shape[:2]).astype(np.uint64)
    for i in range(values.shape[2]):
        out = mix(out ^ values[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out).view(np.int64)


def node_of(documents: DataFrame) -> Column:
    """The number by which a row is known: its doc_id, or a hash of its text, or null where both are."""
    return F.coalesce(documents["doc_id"].cast("long"), F.when(documents["text"].isNotNull(), F.xxhash64(documents["text"].cast("string"))))


def sketch(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, id (its node), n_shingles, f1, f2, sig of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = 0
            for part in parts(_slowly(b.column(2), b.column(1))):
                sets = shingles([t for _, t in part], words)
                f = [fingerprint(s) for s in sets]
                cols = [b.column(0).slice(at, len(part)), b.column(1).slice(at, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in f], pa.int64()), pa.array([x for _, x in f], pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "id", "n_shingles", "f1", "f2", "sig"])
                at += len(part)

    slim = documents.select(documents["doc_id"].cast("long"), node_of(documents).alias("id"), documents["text"].cast("string"))
    return slim.mapInArrow(run, "doc_id long, id long, n_shingles long, f1 long, f2 long, sig binary")


def _slowly(texts, ids):
    """(id, text) of two Arrow columns, a few rows in Python at a time."""
    for at in range(0, len(ids), 512):
        yield from zip(ids.slice(at, 512).to_pylist(), texts.slice(at, 512).to_pylist(), strict=True)


def _bands(reps: DataFrame) -> DataFrame:
    """key, id: the bands of each signature; the last five bits of a key are the number of its band."""

    def run(batches):
        import pyarrow as pa

        n = BANDS
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                keys = _keys(_signatures(part.column(1))[:, : n * ROWS].reshape(-1, n, ROWS), np.arange(n, dtype=np.uint64)[None, :])
                keys = keys & ~np.int64(n - 1) | np.arange(n)[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), n))], ["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def _splits(members: DataFrame, level: int) -> DataFrame:
    """key, id: sub-buckets of members (key, id, sig) by further rows of their signatures."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                values = _signatures(part.column(2))[:, _SPLIT_ROWS[level].ravel()].reshape(-1, SPLITS, ROWS)
                salt = mix(part.column(0).to_numpy().view(np.uint64)[:, None] + np.arange(SPLITS, dtype=np.uint64)[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(_keys(values, salt).ravel()), pa.array(np.repeat(part.column(1).to_numpy(), SPLITS))], ["key", "id"])

    return members.select("key", "id", "sig").mapInArrow(run, "key long, id long")


def _shared(buckets: DataFrame) -> DataFrame:
    """key, id, n, lead of the buckets with more than one id; the caller releases it.

    lead: the member whose buckets hold the most members in all; ties go to the smaller id.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("__low"), F.max("id").alias("__top")).filter("__low < __top")
    shared = kept(buckets.join(sizes.select(F.col("key").alias("__key"), "n"), F.col("key") == F.col("__key")).select("key", "id", "n"))
    company = shared.groupBy("id").agg(F.sum("n").alias("company")).select(F.col("id").alias("__id"), "company")
    best = shared.join(company, F.col("id") == F.col("__id")).groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("minus")))["minus"].alias("minus"))
    out = kept(shared.join(best.select(F.col("key").alias("__key"), (-F.col("minus")).alias("lead")), F.col("key") == F.col("__key")).select("key", "id", "n", "lead"))
    out.count()
    release(shared)
    return out


def _pruned(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Those of the distinct pairs (a, b) that signatures leave possible."""
    least = least_matches(threshold)

    def run(batches):
        import pyarrow as pa

        for x in batches:
            for at in range(0, x.num_rows, 4096):
                part = x.slice(at, 4096)
                yield part.select([0, 1]).take(pa.array(possible(_signatures(part.column(2)), _signatures(part.column(3)), least)))

    s = reps.select("id", "sig")
    both = pairs.join(s.withColumnsRenamed({"id": "a", "sig": "sa"}), "a").join(s.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets(documents: DataFrame, ids: DataFrame, words: int, several: bool) -> DataFrame:
    """id, own: the full shingle sets of the nodes with these ids (column id), from their texts; kept.

    several: a node may have texts with different sets; each is a row.
    """

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            for part in parts(_slowly(b.column(1), b.column(0))):
                own = [(i, s.tobytes()) for (i, _), s in zip(part, shingles([t for _, t in part], words), strict=True) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([o for _, o in own], pa.binary())], ["id", "own"])

    used = ids.distinct()
    if used.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        used = F.broadcast(used)
    slim = documents.select(node_of(documents).alias("id"), documents["text"].cast("string").alias("text"))
    found = slim.join(used, "id", "left_semi").mapInArrow(sets, "id long, own binary")
    return kept(found.distinct() if several else found.dropDuplicates(["id"]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(b, a)
    n = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * n >= percent * (len(a) + len(b) - n)


def _verified(pairs: DataFrame, documents: DataFrame, words: int, percent: int, several: bool) -> DataFrame:
    """Those of the pairs (a, b) whose full sets link, in a table of its own."""
    pairs = written(pairs, "survivors")

    def link(batches):
        import pyarrow as pa

        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                both = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                yield part.select([0, 1]).filter(pa.array([linked(np.frombuffer(o, np.uint64), np.frombuffer(q, np.uint64), percent) for o, q in both], pa.bool_()))

    full = _sets(documents, pairs.select(F.explode(F.array("a", "b")).alias("id")), words, several)
    both = pairs.join(full.withColumnsRenamed({"id": "a", "own": "oa"}), "a").join(full.withColumnsRenamed({"id": "b", "own": "ob"}), "b")
    out = written(both.select("a", "b", "oa", "ob").mapInArrow(link, "a long, b long"), "links")
    release(full)
    drop_table(pairs)
    return out


def _tile_pairs(ids, comp, side, sig, least, band):
    """Rows u, v of the possible pairs of a tile, of different components.

    side: 0 for the first block, 1 for the second; a tile of one block has zeros only. band: of the tile's bucket; a
    pair that shares an earlier band is left to that band's bucket. None: all pairs.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
    for at in range(0, len(left), 64):
        p = left[at : at + 64]
        meet = comp[p][:, None] != comp[right][None, :]
        if not side.max():
            meet &= ids[p][:, None] < ids[right][None, :]
        u, v = np.nonzero(meet)
        u, v = p[u], right[v]
        alive = possible(sig, sig, least, u, v)
        u, v = u[alive], v[alive]
        if band:
            before = slice(0, band * ROWS)
            u_v = (sig[u, before] == sig[v, before]).reshape(len(u), band, ROWS).all(axis=2).any(axis=1)
            u, v = u[~u_v], v[~u_v]
        yield u, v


def _each_tile(pdf, least, first_band: bool):
    """pdf sorted by tile, and rows u, v of the possible pairs of each tile."""
    pdf = pdf.sort_values(["key", "i", "j"], kind="stable").reset_index(drop=True)
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, HASHES)
    key, i, j, x, ids, comp = (pdf[c].to_numpy() for c in ("key", "i", "j", "x", "id", "comp"))
    edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    none = np.zeros(0, np.int64)
    found = [(none, none)]
    for lo, hi in zip([0, *edge], [*edge, len(key)], strict=True) if len(key) else []:
        side = ((x[lo:hi] == j[lo:hi]) & (i[lo:hi] != j[lo:hi])).astype(int)
        band = int(key[lo] & (BANDS - 1)) if first_band else None
        found += [(u + lo, v + lo) for u, v in _tile_pairs(ids[lo:hi], comp[lo:hi], side, sig[lo:hi], least, band)]
    return pdf, np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def _bundled(tiles: DataFrame, rows: int, of: int):
    """Tiles in groups of about so many of the `of` rows; a tile is in one group."""
    return tiles.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(16, of // rows))).cast("int").alias("bundle"))


def _tiles(members: DataFrame) -> DataFrame:
    """key, i, j, x, id, comp: members (key, id, comp, n) in every tile (i, j) of their bucket that their block x is in.

    The blocks of a bucket's largest component come first and make no tiles with each other, since members of one
    component need not meet. So a member of it is copied once for each block of the others, and only the others are
    copied for every block.
    """
    small = members.filter(F.col("n") <= BLOCK).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("x"), "id", "comp")
    large = members.filter(F.col("n") > BLOCK).select("key", "id", "comp")
    each = large.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = each.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    main = main.select(F.col("key").alias("__key"), F.col("main")["comp"].alias("main"), blocks(F.col("main")["c"]).alias("p"), blocks(F.col("all") - F.col("main")["c"]).alias("q"))
    cut, is_main, h = large.join(main, F.col("key") == F.col("__key")), F.col("comp") == F.col("main"), F.xxhash64("id")
    cut = cut.withColumn("x", F.when(is_main, F.pmod(h, F.col("p"))).otherwise(F.col("p") + F.pmod(h, F.col("q"))).cast("int"))
    cut = cut.withColumn("y", F.explode(F.sequence(F.when(is_main, F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)))
    return small.unionByName(cut.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "comp"))


def _linked_blocks(members: DataFrame, reps: DataFrame, documents: DataFrame, words: int, percent: int, first_band: bool, several: bool) -> DataFrame:
    """Links (a, b) between different components in buckets (key, id, comp, n): blocks of each against blocks.

    A tile holds two blocks of about BLOCK members; small ones share a group. The signatures of a tile tell which of
    its members have a possible partner in it; only those get their full sets, and the tile compares them again, now
    to the end. No row is made of a pair but of a link.
    """
    threshold = percent / 100
    least = least_matches(threshold)
    tiles = _tiles(members)
    sigs = reps.select(F.col("id").alias("__id"), "sig")
    signed = lambda t: t.join(sigs, F.col("id") == F.col("__id")).drop("__id")

    def partners(pdf):
        pdf, u, v = _each_tile(pdf, least, first_band)
        return pdf.loc[np.unique(np.concatenate([u, v])), ["key", "i", "j", "x", "id", "comp"]]

    def link(pdf):
        import pandas as pd

        pdf, u, v = _each_tile(pdf, least, first_band)
        own = [np.frombuffer(o, np.uint64) for o in pdf["own"]]
        good = [linked(own[p], own[q], percent) for p, q in zip(u, v, strict=True)]
        ids = pdf["id"].to_numpy()
        a, b = ids[u[good]], ids[v[good]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    kind = "key long, i int, j int, x int, id long, comp long"
    some = written(_bundled(signed(tiles), BUNDLE, tiles.count()).applyInPandas(partners, kind), "partners")
    full = _sets(documents, some.select("id"), words, several)
    whole = signed(some).join(full.withColumnRenamed("id", "__of"), F.col("id") == F.col("__of")).drop("__of")
    out = written(_bundled(whole, SETS, some.count()).applyInPandas(link, "a long, b long").distinct(), "links")
    release(full)
    drop_table(some)
    return out


def _labels(links: list[DataFrame]) -> DataFrame:
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    return components(every.select("a", "b"))


def _grouped(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, id (its node), n_shingles, root, component of every row, in a table of its own.

    Rows of one group have one root, a node of the group: its smallest doc_id if it has any, which then is its
    component as well; else component is null.
    """
    threshold = percent / 100
    docs = kept(sketch(documents, words))
    worded = docs.filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("id")))["id"]
    reps = kept(worded.groupBy("f1", "f2").agg(first.alias("id"), F.first("sig").alias("sig"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")))
    twice = worded.groupBy("id").agg(*[f(c).alias(f"{k}{c}") for c in ("f1", "f2") for k, f in (("lo", F.min), ("hi", F.max))])
    twice = kept(twice.filter("lof1 <> hif1 OR lof2 <> hif2").select(F.col("id").alias("__id")))
    several, links, labels = not twice.isEmpty(), [], None
    if several:  # what a doc_id's own texts are in belongs together
        own = worded.join(twice, F.col("id") == F.col("__id")).select("id", "f1", "f2").distinct()
        links.append(written(own.join(reps.select("f1", "f2", F.col("id").alias("b")), ["f1", "f2"]).select(F.col("id").alias("a"), "b"), "links"))
    members = _shared(_bands(reps))
    for level in range(LEVELS + 1):
        stars = members.filter("id <> lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
        links.append(_verified(_pruned(stars, reps, threshold), documents, words, percent, several))
        if labels is not None:
            drop_table(labels)
        labels = _labels(links)
        # the lead of a bucket has been compared with all others
        rest = members.filter("n > 2 AND id <> lead").join(labels.withColumnsRenamed({"id": "__id"}), F.col("id") == F.col("__id"), "left")
        rest = rest.select("key", "id", F.coalesce("component", "id").alias("comp"), (F.col("n") - 1).alias("n"))
        mixed = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(F.col("key").alias("__key"))
        rest = written(rest.join(mixed, F.col("key") == F.col("__key")).drop("__key"), "mixed")
        release(members)
        large = F.col("n") > SPLIT if level < LEVELS else F.lit(False)
        done = rest.filter(large).isEmpty()
        links.append(_linked_blocks(rest.filter(~large), reps, documents, words, percent, done and not level, several))
        if not done:
            signed = rest.filter(large).join(reps.select(F.col("id").alias("__id"), "sig"), F.col("id") == F.col("__id"))
            members = _shared(_splits(signed, level))
        drop_table(rest)
        if done:
            break
    drop_table(labels)
    labels = _labels(links)
    named = reps.join(labels.withColumnsRenamed({"id": "__id"}), F.col("id") == F.col("__id"), "left")
    root = F.coalesce("component", "id")
    named = named.select("f1", "f2", "n", root.alias("root"), root.alias("component"), F.when(F.col("nulls") < F.col("n"), F.col("id")).alias("real"), "nulls")
    if not named.filter("nulls > 0").isEmpty():  # a root may be the hash of a text
        best = named.groupBy(F.col("root").alias("__root")).agg(F.min("real").alias("best"), F.sum("nulls").alias("some")).filter("some > 0")
        named = named.join(best, F.col("root") == F.col("__root"), "left")
        named = named.withColumns({"component": F.when(F.col("some").isNull(), F.col("root")).otherwise(F.col("best")), "root": F.coalesce("best", "root")})
    out = joined_by_hot_keys(worded.select("doc_id", "id", "n_shingles", "f1", "f2"), named.select("f1", "f2", "n", "root", "component"), ["f1", "f2"]).drop("f1", "f2")
    wordless = docs.filter("n_shingles = 0").select("doc_id", "id", "n_shingles", F.col("id").alias("root"), F.col("doc_id").alias("component"))
    out = written(out.unionByName(wordless), "groups")
    release(docs, reps, twice)
    for x in (labels, *links):
        drop_table(x)
    return out


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, from a table of its own.

    Texts: A-Z as a-z, words between white space, distinct shingles of so many words; of any length. Null, empty and
    wordless texts have an empty set and no links: component_id is the row's own doc_id. Rows that share a doc_id are
    one document: those with words are in one group, which has the links of all their texts; n_shingles is each row's
    own. Rows without a doc_id are documents by their text; their component_id is the smallest doc_id of the group,
    null if there is none, and kept is then true. An empty table has no rows. Only doc_id and text are read.

    The node of a row without a doc_id is a 64-bit hash of its text, which equals a doc_id with a chance of 2 ** -64.
    """
    g = _grouped(documents, words, percent).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return g.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def deduplicate(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with the columns as they came.

    Of a group stays the smallest doc_id, of groups without any the text with the smallest hash. Of rows that share a
    doc_id, or without one a text, one stays: one with words if there is, then that with the smallest hash of its
    text; rows equal in text differ in no column that is read here, and any of them may stay. Rows without a doc_id
    and without words all stay. Columns of any name pass through. An empty table stays one.
    """
    g, (node, lost, twice, row) = _grouped(documents, words, percent), (fresh(documents, x) for x in ("__node", "__gone", "__again", "__row"))
    gone = g.filter("id <> root").select(F.col("id").alias(lost)).distinct()
    again = g.filter("id = root AND (doc_id IS NOT NULL OR n_shingles > 0)").groupBy(F.col("id").alias(twice)).agg(F.count("*").alias("n")).filter("n > 1").select(twice)
    few = lambda ids: F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    columns = [F.col(f"`{c}`") for c in documents.columns]
    left = documents.withColumn(node, node_of(documents)).join(few(gone), F.col(node) == F.col(lost), "left_anti")
    if not again.isEmpty():
        again = few(again)
        worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        on, one = F.col(node) == F.col(twice), F.min_by(F.struct(*columns), F.struct(~worded, F.xxhash64(F.col("text").cast("string"))))
        named = worded | F.col("doc_id").isNotNull()
        once = left.filter(named).join(again, on, "left_semi").groupBy(node).agg(one.alias(row)).select(*[F.col(row)[c].alias(c) for c in documents.columns])
        left = left.filter(~named).select(*columns).unionByName(left.filter(named).join(again, on, "left_anti").select(*columns)).unionByName(once)
    return left.select(*columns)
