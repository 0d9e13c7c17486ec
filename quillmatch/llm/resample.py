"""Quality by importance resampling.

Two generative models of hashed word and word-pair counts are fitted: of target text (labelled good) and of raw text
(all documents). Both are distributions over the buckets, (count + SHRINK) / (sum + SHRINK * buckets), raw counts
scaled to the target's sum. A document's log weight is the log ratio of its likelihoods. Gumbel noise is added and the
k highest keys are kept, which samples k documents without replacement with chances in proportion to their weights, or
to a power 1 / temperature of them. k is given, or calibrated so that hardly any target text is lost; log weights of
whole documents spread over hundreds, so at temperature 1 the noise then decides between few.

A few toxic words in a long text move that ratio little, so a second one is fitted on labelled text alone: in how many
toxic documents each bucket occurs, against all labelled ones. A document's toxicity is the sum of its strongest
buckets, and what exceeds nearly all held-out clean text is rejected whatever its quality.

The noise is a hash of the document, so a lost task repeats it and any pass can recompute it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import written
from quillmatch.llm.wordhash import TEXT, mix, parts, word_hashes

#: Buckets of words, and as many of word pairs.
BUCKETS = 1 << 17

#: Pseudo-counts by which a bucket's ratio is drawn to 1: rare buckets say nothing.
SHRINK = 5.0

#: At most so many labelled documents are target text; a fifth of them only calibrate.
MAX_TARGET = 50_000

#: The share of held-out target text that may weigh less than all that is kept.
TARGET_LOSS = 0.001

#: So many of a document's buckets make its toxicity: a few words count in a text of any length.
STRONGEST = 5

#: Pseudo-counts of documents for the toxic ratio.
TOXIC_SHRINK = 2.0

#: The share of held-out clean text that may be rejected as toxic.
CLEAN_LOSS = 0.001

#: Columns of a labelled document's role in each sample: 1 is fitted on, 2 is held out.
ROLES = ("__target", "__toxic", "__clean")


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each text's words and word pairs, and how many each text has."""
    words, n = word_hashes(texts, TEXT)
    of = np.repeat(np.arange(len(texts)), n)
    pairs = mix(words[:-1] * np.uint64(31) + words[1:])[of[:-1] == of[1:]]
    pair_of = of[:-1][of[:-1] == of[1:]]
    low = np.uint64(buckets - 1)
    at = np.concatenate([(words & low).astype(np.int64), (pairs & low).astype(np.int64) + buckets])
    order = np.argsort(np.concatenate([of, pair_of]), kind="stable")
    return at[order], n + np.maximum(n - 1, 0)


@dataclass(frozen=True)
class Model:
    """weights: log ratio of each bucket; seed: of the noise; floor: the lowest key that is kept; toxic: log ratio of
    each bucket in toxic text, if any is labelled; limit: the highest toxicity that is kept."""

    weights: np.ndarray
    seed: int
    floor: float = -np.inf
    toxic: np.ndarray | None = None
    limit: float = np.inf
    temperature: float = 1.0

    def keys(self, doc_ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of features, log weight and key of each document."""
        return self.scores(doc_ids, texts)[:3]

    def keeps(self, doc_ids: list, texts: list[bytes]) -> np.ndarray:
        """Whether each document's key reaches the floor and its toxicity is within the limit."""
        _, _, key, toxicity = self.scores(doc_ids, texts)
        return (key >= self.floor) & (toxicity <= self.limit)

    def scores(self, doc_ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of features, log weight, key and toxicity of each document."""
        at, n = features(texts, len(self.weights) // 2)
        weight = np.bincount(np.repeat(np.arange(len(texts)), n), self.weights[at], minlength=len(texts)).astype(float)
        whole = np.zeros(len(texts), np.uint64)
        np.add.at(whole, np.repeat(np.arange(len(texts)), n), mix(at.astype(np.uint64)))
        own = np.array([(d if d is not None else -1) & (2**64 - 1) for d in doc_ids], np.uint64)
        u = (mix(mix(own + np.uint64(self.seed)) ^ whole) >> np.uint64(11)).astype(np.float64) / 2.0**53
        return n, weight, weight / self.temperature - np.log(-np.log(np.clip(u, 2.0**-54, 1 - 2.0**-53))), self._toxicity(at, n)

    def _toxicity(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of the STRONGEST highest log ratios above 0 among each document's distinct buckets."""
        if self.toxic is None:
            return np.zeros(len(n))
        some = self.toxic[at] > 0
        distinct = np.unique(np.repeat(np.arange(len(n)), n)[some] * len(self.toxic) + at[some])
        of, ratio = distinct // len(self.toxic), self.toxic[distinct % len(self.toxic)]
        order = np.lexsort((-ratio, of))
        of, ratio = of[order], ratio[order]
        top = np.arange(len(of)) - np.searchsorted(of, of) < STRONGEST
        return np.bincount(of[top], ratio[top], minlength=len(n)).astype(float)


def _sample(labels: DataFrame, which: Column, limit: int, kind: int) -> DataFrame:
    """At most `limit` doc_ids of labels by the order of a hash, a kind, and a role: 2 if held out, else 1."""
    ids = labels.filter(which & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(limit)
    return ids.select("doc_id", F.when(F.pmod("h", F.lit(5)) == 0, 2).otherwise(1).alias("role"), F.lit(kind).alias("kind"))


def _roles(labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, __target, __toxic, __clean: roles of labelled documents, null where they have none."""
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None).cast("boolean")
    every = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("good"), toxic.alias("toxic"))
    bad = every.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    samples = [_sample(every, F.col("good"), limit, 0), _sample(bad, F.col("toxic"), limit, 1), _sample(bad, ~F.col("toxic"), limit, 2)]
    each = [F.max(F.when(F.col("kind") == i, F.col("role"))).alias(c) for i, c in enumerate(ROLES)]
    return samples[0].unionByName(samples[1]).unionByName(samples[2]).groupBy("doc_id").agg(*each)


def fit(documents: DataFrame, labels: DataFrame, seed: int = 17, buckets: int = BUCKETS, shrink: float = SHRINK, max_target: int = MAX_TARGET, target_loss: float = TARGET_LOSS, k: int | None = None, temperature: float = 1.0) -> tuple[Model, DataFrame]:
    """The model with its floor, and doc_id, n_features, log_weight, key, toxicity of every document, in a table of its own.

    Raw counts are of all documents. k is given, or the number of documents that are within the toxic limit and weigh
    at least as much as all but a share of target_loss of the held-out target text; the floor is the k-th highest key
    among those within the limit, and rows that tie there are all kept. The limit is what all but a share of CLEAN_LOSS
    of the held-out clean text stays within, and of the fitted clean text, as little of it may be held out; without
    labelled toxic text, or clean text held out, there is none. Null and empty texts weigh 0, as does every document
    without target text. Repeated rows have one key and are kept or go together; a null doc_id counts as -1 in the
    noise. An empty table has no rows. labels: doc_id, good, and toxic if known; other columns are not read.
    """
    slim = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    docs = slim.join(F.broadcast(_roles(labels, max_target)), "doc_id", "left")

    def count(batches):
        import pyarrow as pa

        raw, target, toxic, clean = (np.zeros(2 * buckets + 1, np.int64) for _ in range(4))  # the last: documents
        for b in batches:
            roles = zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
            for part in parts(zip(roles, _strings(b.column(0)), strict=True)):
                at, n = features([t for _, t in part], buckets)
                raw += np.bincount(at, minlength=2 * buckets + 1)
                target += np.bincount(at[np.repeat([r == 1 for (r, _, _), _ in part], n)], minlength=2 * buckets + 1)
                end = np.cumsum(n)
                for i, held in ((1, toxic), (2, clean)):
                    for own in np.flatnonzero([r[i] == 1 for r, _ in part]):
                        held[np.append(np.unique(at[end[own] - n[own] : end[own]]), 2 * buckets)] += 1
        some = np.flatnonzero(raw + toxic + clean)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x[some]) for x in (raw, target, toxic, clean))], ["b", "raw", "target", "toxic", "clean"])

    sums = [F.sum(c).alias(c) for c in ("raw", "target", "toxic", "clean")]
    counts = docs.select("text", *ROLES).mapInArrow(count, "b int, raw long, target long, toxic long, clean long").groupBy("b").agg(*sums).toArrow()
    at = counts.column("b").to_numpy()
    raw, target, bad, clean = (counts.column(c).to_numpy().astype(float) for c in ("raw", "target", "toxic", "clean"))
    weights = np.zeros(2 * buckets)
    for half in (at < buckets, (at >= buckets) & (at < 2 * buckets)):
        expected = raw[half] * (target[half].sum() / max(1.0, raw[half].sum()))
        weights[at[half]] = np.log((target[half] + shrink) / (expected + shrink))
    n_toxic, n_clean = bad[at == 2 * buckets].sum(), clean[at == 2 * buckets].sum()
    toxic = None
    if n_toxic:
        toxic, own = np.zeros(2 * buckets), at < 2 * buckets
        expected = (bad + clean)[own] * (n_toxic / (n_toxic + n_clean))
        toxic[at[own]] = np.log((bad[own] + TOXIC_SHRINK) / (expected + TOXIC_SHRINK))
    model = Model(weights, seed, toxic=toxic, temperature=temperature)
    scored = written(docs.select("doc_id", "text", "__target", "__clean").mapInArrow(_scorer(model), "doc_id long, target int, clean int, n_features long, log_weight double, key double, toxicity double"), "weights")
    marks = [F.percentile_approx(F.when(F.col(role) == 2, F.col(c)), F.lit(share), F.lit(1_000_000)) for role, c, share in (("target", "log_weight", target_loss), ("clean", "toxicity", 1 - CLEAN_LOSS))]
    fitted = F.percentile_approx(F.when(F.col("clean") == 1, F.col("toxicity")), F.lit(1 - CLEAN_LOSS), F.lit(1_000_000))
    held_out, limit, fitted = scored.agg(*marks, fitted).first()
    limit = np.inf if limit is None else max(limit, fitted or 0.0)
    within = scored.filter(F.col("toxicity") <= F.lit(float(limit)))
    if k is None:
        k = within.count() if held_out is None else within.filter(F.col("log_weight") >= held_out).count()
    return Model(weights, seed, kth_highest(within, "key", k), toxic, limit, temperature), scored


def _strings(column):
    """Values of an Arrow column, a few at a time."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def _scorer(model: Model):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            roles = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            for part in parts(zip(zip(b.column(0).to_pylist(), roles, strict=True), _strings(b.column(1)), strict=True)):
                scores = model.scores([d for (d, _), _ in part], [t for _, t in part])
                cols = [pa.array([d for (d, _), _ in part], pa.int64()), *(pa.array([r[i] for (_, r), _ in part], pa.int32()) for i in (0, 1)), *map(pa.array, scores)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "target", "clean", "n_features", "log_weight", "key", "toxicity"])

    return run


def kth_highest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th highest value of a double column, exactly, by ever finer histograms; no sort of all rows.

    k of 0 gives infinity; k beyond the rows gives the lowest value, or minus infinity for none.
    """
    if k <= 0:
        return float("inf")
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return float("-inf")
    while low < high:
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.col(column)
        rows = df.filter(F.col(column).between(low, high)).groupBy(at.alias("at")).agg(F.count("*"), F.min(column), F.max(column)).collect()
        for _, n, lo, hi in sorted(rows, key=lambda r: -r[2]):
            if k <= n:
                low, high = lo, hi
                break
            k -= n
        else:
            return low
    return float(low)


def keep(documents: DataFrame, model: Model) -> DataFrame:
    """The documents whose key reaches the model's floor and that are within its toxic limit, with all their columns.

    One pass, no shuffle; each row by itself, nulls and repeats as in fit.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("text"))
            kept = []
            for part in parts(zip(ids.to_pylist(), _strings(texts), strict=True)):
                kept.append(model.keeps([d for d, _ in part], [t for _, t in part]))
            yield b.filter(pa.array(np.concatenate(kept))) if kept else b

    return documents.mapInArrow(run, documents.schema)


def select_documents(documents: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_features, log_weight, key, selected of every document."""
    model, scored = fit(documents, labels, **parameters)
    return scored.select("doc_id", "n_features", "log_weight", "key", ((F.col("key") >= model.floor) & (F.col("toxicity") <= F.lit(float(model.limit)))).alias("selected"))


def good_labels(labels: DataFrame) -> DataFrame:
    """doc_id, good (quality 1 and not toxic; nulls are not good), toxic (null if unknown)."""
    return labels.select("doc_id", F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False)).alias("good"), (F.col("toxic") == 1).alias("toxic"))
