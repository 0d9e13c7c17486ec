"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.operators.hotkeys import BROADCAST_ROWS, fresh, joined_by_hot_keys
from quillmatch.sources.scratch import drop_path, drop_table, scratch, shared_dir, written

#: Sets of ids of up to so many rows are broadcast to pick rows; larger ones are joined by shuffle.
BROADCAST_IDS = BROADCAST_ROWS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read only through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes the fast built-in path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def kept(df: DataFrame) -> DataFrame:
    """df, computed once at its first use and held on the executors' disks until released.

    What a lost executor held is computed again from its lineage. For steps of one operator that are used a few
    times; a table that outlives the operator is written instead.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def release(*frames: DataFrame) -> None:
    """Gives up what kept() holds."""
    for df in frames:
        df.unpersist()


__all__ = ["BROADCAST_IDS", "LOWER", "UPPER", "ascii_lower", "drop_path", "drop_table", "fresh", "joined_by_hot_keys", "kept", "release", "scratch", "shared_dir", "table", "written"]
