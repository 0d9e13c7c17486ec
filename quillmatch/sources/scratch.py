"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Unset, local runs use /tmp and a cluster gets an error, not local folders."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/quillmatch"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below a folder of this application, which is deleted when its driver exits; one that is killed leaves it."""
    root = f"{shared_dir(spark)}/quillmatch-{spark.sparkContext.applicationId}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, reread. Survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what written() made."""
    drop_path(df.sparkSession, df.written_to)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through the Hadoop file system that owns it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
