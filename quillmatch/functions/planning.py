"""Hints to the optimiser that change no result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(value: Column) -> Column:
    """value, computed once where it stands: the optimiser moves no filter below it and copies it into nothing above.

    Without this an array that a lambda or a filter uses may be computed anew there, even once per element.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores: a small file is one task, whatever its rows cost later."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
