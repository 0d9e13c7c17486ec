"""Sinks: tables, models and small renderings."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_models(models: dict, path: str) -> None:
    """Fitted models by name, one folder each."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_models(spark: SparkSession, path: str, names: list[str]) -> dict:
    """Models that save_models wrote, by name."""
    from pyspark.ml.util import DefaultParamsReader

    return {n: DefaultParamsReader.loadParamsInstance(f"{path}/{n}", spark.sparkContext) for n in names}


def write_results(models: dict, predictions: DataFrame, path: str) -> None:
    """Models, predictions (model, key, label, prediction, score; part) and each model's confusion matrix (of part test, if there are parts), below one folder."""
    save_models(models, f"{path}/models")
    write_table(predictions, f"{path}/predictions", ["model"])
    tested = predictions.filter("part = 'test'") if "part" in predictions.columns else predictions
    counts = tested.filter("label IS NOT NULL").groupBy("model", "label").agg(F.count_if(F.col("prediction") == 0).alias("predicted_0"), F.count_if(F.col("prediction") == 1).alias("predicted_1"))
    write_table(counts, f"{path}/confusion")


def read_results(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """What write_results wrote: models by name, predictions, confusion matrices."""
    predictions, counts = spark.read.parquet(f"{path}/predictions"), spark.read.parquet(f"{path}/confusion")
    names = [r["model"] for r in counts.select("model").distinct().collect()]
    return load_models(spark, f"{path}/models", names), predictions, counts


def results_path(features_path: str, folder: str = "results", suffix: str = "-results") -> str:
    """Where the results of a feature table go: beside it, named after it."""
    head, name = posixpath.split(features_path.rstrip("/"))
    return posixpath.join(head, folder, posixpath.splitext(name)[0] + suffix)


def html_table(df: DataFrame, rows: int) -> str:
    """A few rows for display."""
    return df.limit(rows).toPandas().to_html(index=False)
