"""Sources. Schemas are declared; a missing path is Spark's own analysis error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch import schemas
from quillmatch.functions.text import dataset_of, file_category


def read_pairs(spark: SparkSession, path: str, sep: str = "#####") -> DataFrame:
    """Labelled pairs from delimited text files without a header, with file name, dataset and category.

    Lines are split by hand: a CSV reader would take a leading quote for quoting.
    """
    part = F.split("value", F.lit(sep), 3)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path).select(
        F.get(part, F.lit(0)).alias("offer_id_1"),
        F.get(part, F.lit(1)).alias("offer_id_2"),
        F.get(part, F.lit(2)).try_cast("tinyint").alias("label"),
        name.alias("filename"),
        dataset_of(name).alias("dataset"),
        file_category(name).alias("file_category"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, schemas.OFFER_RAW)


def read_clusters(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """cluster_id, category, id_values; only some categories if given."""
    found = read_json_lines(spark, path, schemas.CLUSTER_RAW).withColumnRenamed("id", "cluster_id")
    return found.filter(F.col("category").isin(categories)) if categories else found


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """url and its key-value pairs, where there are any."""
    return read_json_lines(spark, path, schemas.SPEC_RAW).filter(F.size("keyValuePairs") > 0)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def parse_lines(lines: DataFrame, schema: str, column: str = "value", keep: list[str] = ()) -> DataFrame:
    """Rows of text lines that each hold a JSON object, after the columns to keep; broken lines give nulls."""
    return lines.select(*keep, F.from_json(column, schema).alias("__r")).select(*keep, "__r.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; it is made and written first if it is not there whole."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
