"""A stateless streaming variant of the ingest (an extension): files that arrive are thinned out and flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.operators.relational import BROADCAST_KEYS


def stream_files(spark: SparkSession, folder: str, schema, files_per_batch: int = 64, suffix: str = "*.parquet") -> DataFrame:
    """A stream of the rows of Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", suffix).parquet(folder)


def ingest(stream: DataFrame, keys: DataFrame, on: str, flatten) -> DataFrame:
    """The stream's wanted rows, flattened; the keys are a static table and broadcast only when they are few."""
    wanted = keys.select(on).distinct()
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return flatten(stream.join(F.broadcast(wanted) if few else wanted, on, "left_semi"))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes all that is there, exactly once over restarts with the same checkpoint, and ends."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
