"""Evaluation of match classifiers from rows of label (0 or 1), prediction and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outcome(label: Column, prediction: Column) -> Column:
    """TP, TN, FP or FN; null where a side is."""
    return F.when((label == 1) & (prediction == 1), "TP").when((label == 0) & (prediction == 0), "TN").when((label == 0) & (prediction == 1), "FP").when((label == 1) & (prediction == 0), "FN")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, predicted_0, predicted_1: one pass with partial sums."""
    p = F.col(prediction)
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count_if(p == 0).alias("predicted_0"), F.count_if(p == 1).alias("predicted_1"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores(df: DataFrame, groups: list[str] = (), label: str = "label", prediction: str = "prediction", positive: int = 1) -> DataFrame:
    """precision, recall, f1 of the positive class by group; 0 where nothing is to divide by."""
    y, p = F.col(label) == positive, F.col(prediction) == positive
    n = df.groupBy(*groups).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select(*groups, _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class, precision, recall, f1, support of both classes, and their macro and weighted averages."""
    total = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    each = None
    for c in (0, 1):
        one = scores(df, [], label, prediction, c).withColumn("class", F.lit(str(c))).withColumn("support", total.select(f"n{c}").scalar())
        each = one if each is None else each.unionByName(one)
    names = ["precision", "recall", "f1"]
    macro = each.agg(*[F.avg(x).alias(x) for x in names], F.sum("support").alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = each.agg(*[_ratio(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in names], F.sum("support").alias("support")).withColumn("class", F.lit("weighted avg"))
    return each.unionByName(macro).unionByName(weighted).select("class", *names, "support")


def mean_scores(scores_of: DataFrame, by: str) -> DataFrame:
    """by, metric, score: the means of precision, recall and f1 of the rows of each value, one metric a row."""
    means = scores_of.groupBy(by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return means.unpivot([by], ["precision", "recall", "f1"], "metric", "score")


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", buckets: int = 4096) -> DataFrame:
    """threshold, precision, recall for every distinct score as the least that is predicted 1.

    Counts per distinct score come first; their running sums are taken within ranges of the score and offset by the
    sums of the ranges above, so no window holds all scores.
    """
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("n"))
    low, high = per.agg(F.min("threshold"), F.max("threshold")).first()
    width = ((high - low) / buckets or 1.0) if low is not None else 1.0
    at = F.floor((F.col("threshold") - F.lit(low or 0.0)) / width).cast("int")
    per = per.withColumn("at", at)
    ranges = per.groupBy("at").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = W.orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("at", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"), F.sum("rp").over(W.partitionBy()).alias("all"))
    own = W.partitionBy("at").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    run = per.withColumns({"cp": F.sum("p").over(own), "cn": F.sum("n").over(own)}).join(F.broadcast(ranges), "at")
    tp, n = F.col("cp") + F.col("bp"), F.col("cn") + F.col("bn")
    return run.select("threshold", (tp / n).alias("precision"), _ratio(tp, F.col("all")).alias("recall"))


def pr_area(curve: DataFrame, buckets: int = 4096) -> DataFrame:
    """auc: the trapezoids under precision over recall, to the point (recall 0, precision 1).

    Trapezoids are summed within ranges of the threshold; one window over the ranges' ends adds those between them.
    """
    low, high = curve.agg(F.min("threshold"), F.max("threshold")).first()
    width = ((high - low) / buckets or 1.0) if low is not None else 1.0
    at = F.floor((F.col("threshold") - F.lit(low or 0.0)) / width).cast("int")
    own, points = W.partitionBy("at").orderBy(F.desc("threshold")), curve.withColumn("at", at)
    area = lambda r, p, r0, p0: (r - r0) * (p + p0) / 2
    step = points.withColumn("a", area(F.col("recall"), F.col("precision"), F.lag("recall").over(own), F.lag("precision").over(own)))
    point = F.struct("threshold", "recall", "precision")
    ends = step.groupBy("at").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.max(point).alias("first"), F.min(point).alias("last"))
    above = W.orderBy(F.desc("at"))
    r0, p0 = F.coalesce(F.lag("last").over(above)["recall"], F.lit(0.0)), F.coalesce(F.lag("last").over(above)["precision"], F.lit(1.0))
    between = ends.select("a", area(F.col("first")["recall"], F.col("first")["precision"], r0, p0).alias("b"))
    return between.agg(F.sum(F.col("a") + F.col("b")).alias("auc"))


def threshold_picks(curve: DataFrame) -> DataFrame:
    """pick, threshold, precision, recall: the least threshold of precision 1, of recall 1, and of the least gap."""
    point = F.struct("threshold", "precision", "recall")
    gap = F.abs(F.col("precision") - F.col("recall"))
    one = curve.agg(
        F.min(F.when(F.col("precision") == 1, point)).alias("precision_1"),
        F.min(F.when(F.col("recall") == 1, point)).alias("recall_1"),
        F.min(F.struct(gap.alias("gap"), point.alias("at")))["at"].alias("balanced"),
    )
    names = ["precision_1", "recall_1", "balanced"]
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("pick"), F.col(x).alias("at")) for x in names])))
    return rows.select("pick", *[F.col("at")[c].alias(c) for c in ("threshold", "precision", "recall")])
