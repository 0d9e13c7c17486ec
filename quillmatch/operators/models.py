"""Classifiers, scaling, folds and selection on Spark ML."""

from __future__ import annotations

from itertools import product
from math import log

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators import forests, logistic
from quillmatch.operators.relational import hash_split
from quillmatch.sources.scratch import drop_table, written


def standard_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, fitted on fit_on (else df); columns without spread become 0."""
    s = (fit_on or df).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in columns})


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, weight: rows / (classes * rows of the class)."""
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = W.partitionBy()
    return n.select(label, (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label).withColumnRenamed("weight", name)), label)


def stratified_folds(df: DataFrame, label: str, key: str, k: int, buckets: int = 256, name: str = "fold") -> DataFrame:
    """df with fold 0 .. k - 1: rows of a label are dealt in the order of a digest of the key, in turn.

    Ranks are counted within buckets of the hash and offset by the buckets before, so a frequent label is no one
    task's work; folds of a label differ by one row at most.
    """
    h = F.md5(F.col(key).cast("string").cast("binary"))
    rows = df.withColumn("__h", h).withColumn("__b", (F.conv(F.substring("__h", 1, 4), 16, 10).cast("int") % buckets).cast("int"))
    counts = rows.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    before = W.partitionBy(label).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col(label).alias("__l"), F.col("__b").alias("__bb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(W.partitionBy(label, "__b").orderBy("__h", key))
    dealt = rows.withColumn("__r", rank).join(counts, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__bb")))
    return dealt.withColumn(name, ((F.col("__base") + F.col("__r") - 1) % k).cast("int")).drop("__h", "__b", "__r", "__l", "__bb", "__base")


def random_split(df: DataFrame, key: str, percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two parts by a seeded digest of the key: `percent` of the rows, and the rest; the same on every run."""
    at = hash_split([key], percent, seed)
    return df.filter(at), df.filter(~at)


def assembled(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="keep").transform(df)


def fourier_features(df: DataFrame, columns: list[str], gamma: float, n: int = 128, seed: int = 11, name: str = "features") -> DataFrame:
    """n random cosines whose products approach the kernel exp(-gamma * squared distance); a matrix product a batch."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 * gamma) ** 0.5, (n, len(columns))), rng.uniform(0, 2 * np.pi, n)

    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.cos(np.array(x.tolist(), dtype=float) @ w.T + b) * (2.0 / n) ** 0.5))

    x = F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn(name, array_to_vector(F.pandas_udf(run, "array<double>")(x)))


def classifiers(weight: str | None = "weight", seed: int = 0) -> dict:
    """The classifiers by name. The kernel machine is a linear one on Fourier features."""
    w = {"weightCol": weight} if weight else {}
    return {
        "nb": NaiveBayes(modelType="gaussian", **w),
        "lr": LogisticRegression(regParam=0.01, elasticNetParam=0.5, **w),
        "svc": LinearSVC(maxIter=50, **w),
        "rf": RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **w),
        "gbt": GBTClassifier(maxIter=20, maxDepth=4, subsamplingRate=0.8, seed=seed, **w),
    }


#: The axes of the searches, coarse with 2 folds and fine with 3. None: without a limit, or all features.
GRIDS = {
    "svc": {"C": [0.1, 1.0, 10.0, 100.0], "gamma": [1.0, 10.0]},
    "rf": {"depth": [None, 5], "features": ["sqrt", None], "split": [2, 4], "trees": [500, 1000]},
    "gbt": {"rate": [0.025, 0.05], "depth": [None, 5], "features": ["sqrt", None], "trees": [150, 300], "sample": [0.33, 0.67]},
    "rf fine": {"depth": [None, 10], "features": ["sqrt", None], "gain": [0.0, 0.1], "leaf": [1, 5], "split": [2, 5], "trees": [1000, 1500]},
    "gbt fine": {
        "rate": [0.01, 0.025], "depth": [None, 10], "features": ["sqrt", None], "leaves": [None, 10], "gain": [0.0, 0.1], "leaf": [1, 5], "split": [2, 5],
        "trees": [150, 300, 450], "sample": [0.15, 0.33], "warm": [True, False],
    },
}
FOLDS = {"svc": 2, "rf": 2, "gbt": 2, "rf fine": 3, "gbt fine": 3}

#: The deepest tree that Spark grows.
DEEPEST = 30


def spark_params(point: dict, trees: float = 1.0) -> dict:
    """A point of a grid in Spark's parameters of forests and boosted trees.

    A node of fewer than `split` rows is not split: Spark bounds the rows of both halves instead, by half of it. No
    depth: DEEPEST. Spark has no bound of leaves and no warm start; points that differ in these alone are one.
    trees: a factor for their number.
    """
    out = {}
    if "depth" in point:
        out["maxDepth"] = point["depth"] or DEEPEST
    if "features" in point:
        out["featureSubsetStrategy"] = point["features"] or "all"
    if "leaf" in point or "split" in point:
        out["minInstancesPerNode"] = max(point.get("leaf", 1), -(-point.get("split", 2) // 2))
    if "gain" in point:
        out["minInfoGain"] = point["gain"]
    if "trees" in point:
        out["maxIter" if "rate" in point else "numTrees"] = max(1, round(point["trees"] * trees))
    if "rate" in point:
        out["stepSize"] = point["rate"]
    if "sample" in point:
        out["subsamplingRate"] = point["sample"]
    return out


def spark_points(grid: dict[str, list]) -> list[dict]:
    """The distinct points of a grid that Spark can tell apart."""
    found = []
    for p in grid_rows(grid):
        if (q := spark_params(p)) not in found:
            found.append(q)
    return found


def grid_rows(grid: dict[str, list]) -> list[dict]:
    """All combinations."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def grid_size(grid: dict[str, list], folds: int) -> int:
    """Fits of an exhaustive search."""
    return len(grid_rows(grid)) * folds


#: Rows that are worth a task of a fit: each of its hundreds of passes costs more by task than by row.
ROWS = 1 << 14


def dense(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written in parts of ROWS rows, however many it came in. rows: how many it has, if that is known."""
    once = written(df, "rows") if rows is None else None
    parts = (once.count() if rows is None else rows) // ROWS + 1
    made = written((df if once is None else once).repartition(parts), "train")
    if once is not None:
        drop_table(once)
    out = made.coalesce(parts)
    out.written_to = made.written_to
    return out


def grid_search(train: DataFrame, estimator, points: list[dict], fold: str = "fold", folds: int = 2, metric: str = "accuracy", parallelism: int = 4, key: str | None = None):
    """The cross-validated model, refitted on all of train with the best point. fold: a column of whole numbers.

    Points of a forest are judged together, and the best is grown as they were (forests). key: whose digest tells which
    rows a tree draws.
    """
    if metric == "accuracy" and (data := _forest_rows(train, estimator, points, fold, key)):
        scores = forests.held_out_accuracy(data, estimator, points, folds)
        model = forests.fit(data, estimator, points[_best(scores)])
        data.drop()
        return CrossValidatorModel(model, scores)
    maps = [{getattr(estimator, k): v for k, v in p.items()} for p in points]
    judge = MulticlassClassificationEvaluator(metricName=metric)
    held = dense(train)  # else folds are dealt anew for every fold and point
    try:
        return CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol=fold, parallelism=parallelism).fit(held)
    finally:
        drop_table(held)


def _best(scores: list[float]) -> int:
    """The highest score's place; ties go to the earlier point."""
    return max(range(len(scores)), key=lambda i: (scores[i], -i))


def _forest_rows(train: DataFrame, estimator, points: list[dict], fold: str | None, key: str | None) -> forests.Binned | None:
    """train in bins, if `forests` grows what these points say; it knows labels 0 and 1 alone."""
    if not isinstance(estimator, RandomForestClassifier) or not forests.known(estimator, points):
        return None
    data = forests.Binned(train, estimator, fold, key, forests.boosting.BINS)
    if data.binary:
        return data
    data.drop()
    return None


def refitted(train: DataFrame, estimator, point: dict, key: str | None = None):
    """The model of one point on all of train, fitted as grid_search fits its best."""
    if data := _forest_rows(train, estimator, [point], None, key):
        model = forests.fit(data, estimator, point)
        data.drop()
        return model
    return estimator.copy({getattr(estimator, k): v for k, v in point.items()}).fit(train)


def kernel_search(train: DataFrame, columns: list[str], grid: dict[str, list] = GRIDS["svc"], folds: int = 2, components: int = 128, weight: str | None = "weight"):
    """gamma and the cross-validated linear machine on its Fourier features that does best over all C and gamma.

    A cost C per row is a regularisation of 1 / (C * rows).
    """
    n, best = train.count(), None
    svc = classifiers(weight)["svc"]
    for gamma in grid["gamma"]:
        made = grid_search(fourier_features(train, columns, gamma, components), svc, [{"regParam": 1 / (c * n)} for c in grid["C"]], folds=folds)
        if best is None or max(made.avgMetrics) > max(best[1].avgMetrics):
            best = gamma, made
    return best


def search_refit_predict(train: DataFrame, test: DataFrame, points: dict[str, list[dict]], key: str, label: str = "label", folds: int = 2, dev: DataFrame | None = None) -> tuple[dict, DataFrame]:
    """Models by name, each the best of its points over stratified folds and refitted on all of train; and model, key,
    label, prediction, score of the test rows. An empty list of points: fitted as it is. All tables: features, label.

    dev: rows that no search sees. Each best model is scored on them first (rows with part 'dev' beside 'test'), and
    then refitted on train and dev.
    """
    parts = {"train": train, "test": test} | ({} if dev is None else {"dev": dev})
    once = None
    for part, df in parts.items():
        own = df.select(key, label, "features", F.lit(part).alias("__part"))
        once = own if once is None else once.unionByName(own)
    once = written(once, "parts")  # what makes the rows is done once, not for each fold, weight and model
    sizes = {r["__part"]: r["count"] for r in once.groupBy("__part").count().collect()}
    train, test, *rest = (once.filter(F.col("__part") == part).drop("__part") for part in parts)
    n, dev = sizes.get("train", 0), rest[0] if rest else None
    dealt = dense(stratified_folds(with_weights(train, label), label, key, folds), n)  # read by every model
    whole = None if dev is None else dense(with_weights(train.unionByName(dev), label), n + sizes.get("dev", 0))
    made, told = {}, None

    def judged(model, rows: DataFrame, part: str) -> DataFrame:
        out = model.transform(rows)
        score = vector_to_array("probability")[1] if "probability" in out.columns else F.lit(None).cast("double")
        return out.select(F.lit(name).alias("model"), key, label, "prediction", score.alias("score"), *([] if dev is None else [F.lit(part).alias("part")]))

    for name, each in points.items():
        estimator = classifiers()[name]
        found = grid_search(dealt, estimator, each, folds=folds, key=key) if each else None
        made[name] = found.bestModel if each else estimator.fit(dealt)
        parts = []
        if dev is not None:
            parts.append(judged(made[name], dev, "dev"))
            made[name] = refitted(whole, estimator, each[_best(found.avgMetrics)] if each else {}, key)
        for out in [*parts, judged(made[name], test, "test")]:
            told = out if told is None else told.unionByName(out)
    for held in (dealt, whole):
        if held is not None:
            drop_table(held)
    return made, told


def fit_predict(train: DataFrame, test: DataFrame, estimator) -> DataFrame:
    """test with prediction, and score where the model has probabilities."""
    out = estimator.fit(train).transform(test)
    return out.withColumn("score", vector_to_array("probability")[1]) if "probability" in out.columns else out


def stopping_round(losses: list[float], patience: int = 30, tolerance: float = 1e-4) -> int:
    """How many rounds are kept: up to the first whose loss is not below one of the `patience` before it by the tolerance."""
    for i in range(patience, len(losses)):
        if not any(losses[i] + tolerance < x for x in losses[i - patience : i]):
            return i + 1
    return len(losses)


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The boosted model of the first n trees."""
    from pyspark import SparkContext

    sc, own = SparkContext._active_spark_context, model._java_obj
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = own.trees()[i], float(own.treeWeights()[i])
    made = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(own.uid(), trees, weights, own.numFeatures(), own.numClasses())
    return GBTClassificationModel(own.copyValues(made, own.extractParamMap()))


def boosted_with_stop(train: DataFrame, validation: DataFrame, max_iter: int = 100, patience: int = 30, tolerance: float = 1e-4, seed: int = 0, **parameters) -> GBTClassificationModel:
    """Gradient boosting whose rounds end once validation rows have not gained for `patience` of them."""
    model = GBTClassifier(maxIter=max_iter, seed=seed, **parameters).fit(train)
    held = validation.persist()  # the loss is told round by round
    try:
        losses = model.evaluateEachIteration(held)
    finally:
        held.unpersist()
    return first_rounds(model, stopping_round(losses, patience, tolerance))


def importances(model, columns: list[str]) -> list[tuple[str, float]]:
    """Features by importance, highest first; ties by name."""
    return sorted(zip(columns, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


#: The exponents of ten of both axes of the first elastic-net grid.
EXPONENTS = range(-3, 4)


def elastic_net(train: DataFrame, columns: list[str], mixes: list[float] | None = None, penalties: list[float] | None = None, key: str = "vec_id", folds: int = 5, repeats: int = 3, label: str = "label"):
    """The best logistic regression over mixes (held to 0 .. 1; those that then are equal are one) and penalties.

    Accuracy is the mean over `folds` stratified folds, dealt `repeats` times; ties go to the earlier point. All models
    of a penalty are fitted in the same passes over the rows. Returns the model refitted on all of train, its mix and
    its penalty.
    """
    mixes = sorted({min(1.0, max(0.0, x)) for x in (mixes or [10.0**i for i in EXPONENTS])})
    grid = [(m, p) for m in mixes for p in (penalties or [10.0**i for i in EXPONENTS])]
    weighed = "weight" in train.columns
    dealt = train
    for r in range(repeats):
        dealt = stratified_folds(dealt.withColumn("__turn", F.xxhash64(key, F.lit(r))), label, "__turn", folds, name=f"__fold{r}").drop("__turn")
    rows = written(
        dealt.select(
            F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"),
            (F.col("weight").cast("double") if weighed else F.lit(1.0)).alias("w"), F.array(*[f"__fold{r}" for r in range(repeats)]).alias("folds"),
        ), "folds"
    )
    scores = logistic.cross_validated(rows, grid, folds, repeats)
    drop_table(rows)
    mix, penalty = grid[max(range(len(grid)), key=lambda i: (scores[i], -i))]
    lr = LogisticRegression(labelCol=label, maxIter=50, elasticNetParam=mix, regParam=penalty, **({"weightCol": "weight"} if weighed else {}))
    return lr.fit(assembled(train, columns).select(label, "features", *(["weight"] if weighed else []))), mix, penalty


def elastic_net_refined(train: DataFrame, columns: list[str], **parameters):
    """elastic_net twice: over the coarse grid, then over finer values around its best point."""
    _, mix, penalty = elastic_net(train, columns, **parameters)
    return elastic_net(train, columns, finer(mix) if mix else [0.0], finer(penalty), **parameters)


def finer(value: float, multiplier: int = 3) -> list[float]:
    """A refined grid around a value: its multiples up to `multiplier`, and as many even steps up to it from below."""
    return sorted([*(value * i / multiplier for i in range(1, multiplier)), *(value * i for i in range(1, multiplier + 1))])


def finer_values(value: Column, multiplier: int = 3) -> Column:
    """finer() of a column, as an array."""
    v = value.cast("double")
    return F.array(*[v * i / multiplier for i in range(1, multiplier)], *[v * i for i in range(1, multiplier + 1)])


def coefficients(spark, model, columns: list[str]) -> DataFrame:
    """feature, coefficient, importance of a logistic model, joined by feature; the intercept has no importance and goes."""
    values = [float(x) for x in model.coefficients.toArray()]
    coefs = spark.createDataFrame([("(Intercept)", float(model.intercept)), *zip(columns, values, strict=True)], "feature string, coefficient double")
    return coefs.join(spark.createDataFrame([(c, abs(x)) for c, x in zip(columns, values, strict=True)], "feature string, importance double"), "feature")


def correlation_matrix(df: DataFrame, columns: list[str]):
    """Pearson's, of every two columns, as an array: one pass, and only the matrix reaches the driver."""
    from pyspark.ml.stat import Correlation

    return Correlation.corr(assembled(df.select(*columns), columns, "__v"), "__v").first()[0].toArray()


def near_zero_variance(df: DataFrame, columns: list[str], most_ratio: float = 19.0, least_unique: float = 0.1) -> list[str]:
    """Columns of one value, or whose commonest value is over most_ratio times the next one, of few distinct values."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").filter("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    first = W.partitionBy("column").orderBy(F.desc("n"), "value")
    two = counts.withColumn("r", F.row_number().over(first)).filter("r <= 2").groupBy("column").agg(F.max("n").alias("a"), F.count("*").alias("k"), F.min("n").alias("b"))
    size = counts.groupBy("column").agg(F.count("*").alias("unique"), F.sum("n").alias("rows"))
    out = {r["column"]: r for r in two.join(size, "column").collect()}
    return [c for c in columns if c not in out or out[c]["k"] == 1 or (out[c]["a"] / out[c]["b"] > most_ratio and out[c]["unique"] / out[c]["rows"] <= least_unique)]


def informative(df: DataFrame, columns: list[str], most_correlation: float = 0.9) -> list[str]:
    """Columns that vary, and of which no two correlate more than allowed.

    Pairs are looked at in the order of their columns' mean correlation, highest first; of two that correlate too
    much, that goes which correlates more with all columns that are left.
    """
    import numpy as np

    gone = set(near_zero_variance(df, columns))
    kept = [c for c in columns if c not in gone]
    if len(kept) < 2:
        return kept
    m = np.abs(correlation_matrix(df, kept))
    np.fill_diagonal(m, np.nan)
    left = np.ones(len(kept), bool)
    order = np.argsort(-np.nanmean(m, axis=0), kind="stable")
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if left[i] and left[j] and m[i, j] > most_correlation:
                means = np.nanmean(m[:, left], axis=1)
                left[i if means[i] > means[j] else j] = False
    return [c for c, x in zip(kept, left, strict=True) if x]


def stepwise_glm(train: DataFrame, columns: list[str], label: str = "label") -> tuple[list[str], float]:
    """Backward selection of a binomial model by the Bayesian information criterion: what is left, and its value.

    All models of a step, each without one column, are fitted together and start from the one before. Rows with a
    null in a column or the label are left out.
    """
    one = train.select(F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"))
    rows = one.filter(F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull()).persist()
    try:
        n, left = rows.count(), list(range(1, len(columns) + 1))
        beta, deviance = logistic.binomial_fits(rows, [[0, *left]], [[0.0] * (len(left) + 1)])[0]
        best = deviance + log(n) * (len(left) + 1)
        while len(left) > 1:
            fits = logistic.binomial_fits(rows, [[0, *[c for c in left if c != x]] for x in left], [[b for i, b in enumerate(beta) if i != at + 1] for at in range(len(left))])
            value, at = min((d + log(n) * len(left), at) for at, (_, d) in enumerate(fits))
            if value >= best:
                break
            best, beta = value, fits[at][0]
            del left[at]
        return [columns[i - 1] for i in left], float(best)
    finally:
        rows.unpersist()


def inflation_factors(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance-inflation factors: the diagonal of the inverse correlation matrix."""
    import numpy as np

    return dict(zip(columns, np.diag(np.linalg.inv(correlation_matrix(df, columns))).tolist(), strict=True))


def gaussian_parameters(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """label, column, prior, mean, variance of a Gaussian naive Bayes model, in one pass."""
    one = df.groupBy(label).agg(F.count("*").alias("n"), *[F.struct(F.avg(c).alias("mean"), F.var_pop(c).alias("variance")).alias(c) for c in columns])
    one = one.withColumn("prior", F.col("n") / F.sum("n").over(W.partitionBy()))
    rows = one.select(label, "prior", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])))
    return rows.select(label, "column", "prior", F.col("s")["mean"].alias("mean"), F.col("s")["variance"].alias("variance"))
