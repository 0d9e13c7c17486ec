"""Sharding by jump consistent hash (Lamping and Veach, 2014), in column expressions only.

No ring table and no state: the shard follows from the key and the number of shards. Going from n to n + 1
shards moves about 1 / (n + 1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the multiplier of its generator, and two powers of two.
MULTIPLIER, TWO64, TWO33, TWO31 = "2862933555777941757", "18446744073709551616", "8589934592", 2147483648.0

#: Offsets of at most so many (shard, bucket) groups are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 262_144


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key (read as unsigned 64 bits). A null key counts as 0.

    Each of at most `shards` jumps is one step of a fold; steps after the last jump do nothing. The generator's
    64-bit product is taken in decimal(38), whose range holds it exactly.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    dec = lambda c: c.cast("decimal(38,0)")
    k = dec(F.coalesce(key.cast("long"), F.lit(0)))
    state = F.struct(
        F.when(k < 0, dec(k + F.lit(TWO64).cast("decimal(20,0)"))).otherwise(k).alias("k"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(s: Column, _: Column) -> Column:
        product = dec(s["k"].cast("decimal(20,0)") * F.lit(MULTIPLIER).cast("decimal(19,0)")) + F.lit(1).cast("decimal(1,0)")
        after = dec(dec(product) % F.lit(TWO64).cast("decimal(20,0)"))
        high = F.floor(after.cast("decimal(20,0)") / F.lit(TWO33).cast("decimal(10,0)")).cast("double")
        # j is known only after k has moved on, so the next fold step computes it
        return F.struct(after.alias("k"), s["j"].alias("b"), F.floor((s["j"] + 1).cast("double") * (F.lit(TWO31) / (high + 1))).cast("long").alias("j"))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, lambda s, i: F.when(s["j"] < shards, jump(s, i)).otherwise(s))
    return fold["b"].cast("int")


def shard_rows(df: DataFrame, key: str, shards: int, slot_buckets: int = 1024, order: tuple[str, ...] = ()) -> DataFrame:
    """df with shard int, grown_shard int (with one shard more) and slot long, gapless from 0 within a shard.

    Slots come from counts of (shard, key bucket) groups, summed up over the buckets, plus the row's rank in its own
    group; so no task ever sorts a whole shard. The order within a group is key, then `order`. Buckets: 65,536 at most.

    Nulls: a null key counts as 0. Ties and repeated rows: each row has a slot of its own. Empty table: no rows.
    Columns of df named shard, grown_shard or slot are replaced; helper columns have names no table should have.
    """
    # four hex digits of a hash that every engine has, so that slots can be checked elsewhere
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("0")).cast("binary")), 1, 4), 16, 10)
    bucket = F.pmod(digits.cast("int"), F.lit(slot_buckets)).cast("int")
    rows = df.withColumns({"shard": jump_hash(F.col(key), shards), "grown_shard": jump_hash(F.col(key), shards + 1), "__bucket": bucket})
    counts = (
        df.select(jump_hash(F.col(key), shards).alias("__shard"), bucket.alias("__of"))
        .groupBy("__shard", "__of")
        .agg(F.count("*").alias("__n"))
        .withColumn("__base", F.sum("__n").over(W.partitionBy("__shard").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)))
        .select("__shard", "__of", F.coalesce("__base", F.lit(0)).alias("__base"))
    )
    if shards * slot_buckets <= BROADCAST_GROUPS:
        counts = F.broadcast(counts)
    rank = F.row_number().over(W.partitionBy("shard", "__bucket").orderBy(key, *order))
    return (
        rows.withColumn("__rank", rank)
        .join(counts, (F.col("shard") == F.col("__shard")) & (F.col("__bucket") == F.col("__of")))
        .withColumn("slot", F.col("__base") + F.col("__rank") - 1)
        .drop("__bucket", "__shard", "__of", "__base", "__rank")
    )


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document. Null text: size 1, checksum 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(slim, "doc_id", shards, order=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
