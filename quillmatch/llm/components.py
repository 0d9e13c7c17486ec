"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import drop_table, written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, component (the smallest id it reaches) of every id on an edge (a, b), in a table of its own.

    Every step shuffles the edges once or twice and writes them; none gathers a node's neighbours in one place. Steps
    grow with the logarithm of the longest path. No edges: no rows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u0"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("u0")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u0"), "m")
        joined = large.join(low, F.col("u") == F.col("u0"))
        small = joined.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        after = written(small.filter("u <> v").distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    # every edge now leads to the smallest id of its component
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = written(ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    drop_table(now)
    return out
