"""The streaming ingest as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.plans.catalog import query
from quillmatch.sources.scratch import scratch
from quillmatch.streaming import ingest


@query("SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events WHERE user_id IN (SELECT c_custkey FROM customer)")
def stream_ingest(t):
    spark, folder = t._spark, t._folder
    base = scratch(spark, "stream")
    source = ingest.stream_files(spark, folder, t.events.schema, suffix="events.parquet")
    wanted = t.customer.select(F.col("c_custkey").alias("user_id"))
    flat = lambda s: s.select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    ingest.run_available(ingest.ingest(source, wanted, "user_id", flat), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("event_id long, user_id long, k string").parquet(f"{base}/out")
