"""Projections, joins, set operations and row selection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.sources.scratch import written

#: Key sets of up to so many rows are broadcast to thin out a large table; larger ones are joined by shuffle.
BROADCAST_KEYS = 1_000_000

#: Rows of a block that one task pairs, on each side, and candidates of a task: blocks of more rows are cut into tiles.
TILE, CANDIDATES = 4096, 8_000_000

#: Up to so many distinct values are compared with each other once, and pairs of rows look the result up.
VALUES = 1000


def suffixed(df: DataFrame, suffix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(c if c in keep else c + suffix) for c in df.columns])


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(c if c in keep else prefix + c) for c in df.columns])


def clean_names(df: DataFrame) -> DataFrame:
    """Column names with '_' for '.' and without slashes at their ends."""
    return df.toDF(*[c.strip("/").replace(".", "_") for c in df.columns])


def sort_columns(df: DataFrame, first: str = "label") -> DataFrame:
    return df.select(first, *sorted(c for c in df.columns if c != first))


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing; one pass counts them all."""
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns]).first()
    return df.select([f"`{c}`" for c in df.columns if counts[c]])


def without(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or null."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_ids(df: DataFrame, ids: list[str], keep: list[str] = (), name: str = "offer_id") -> DataFrame:
    """One row for each of the id columns; other columns repeat."""
    return df.select(*keep, F.explode(F.array(*ids)).alias(name))


def distinct_offers(pairs: DataFrame) -> DataFrame:
    """offer_id: each offer of a pair, once, however many files it is in."""
    return stack_ids(pairs, ["offer_id_1", "offer_id_2"]).distinct()


def distinct_ids(*frames: tuple[DataFrame, str], name: str = "id") -> DataFrame:
    """The distinct union of one column of each frame."""
    return union_all(*[df.select(F.col(c).alias(name)) for df, c in frames]).distinct()


def semi_join(df: DataFrame, keys: DataFrame, on: str, broadcast_rows: int = BROADCAST_KEYS) -> DataFrame:
    """Rows whose key is wanted. The keys are counted: few are broadcast, so the large side is not shuffled."""
    wanted = keys.select(on).distinct()
    few = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(wanted) if few else wanted, on, "left_semi")


def pair_up(pairs: DataFrame, items: DataFrame, key: str, left: str, right: str, how: str = "inner") -> DataFrame:
    """Pairs with all columns of both items, suffixed _1 and _2: one double join for all attributes."""
    cols = [c for c in items.columns if c != key]
    a = items.select(F.col(key).alias(left), *[F.col(f"`{c}`").alias(f"{c}_1") for c in cols])
    b = items.select(F.col(key).alias(right), *[F.col(f"`{c}`").alias(f"{c}_2") for c in cols])
    return pairs.join(a, left, how).join(b, right, how)


def blocked_pairs(df: DataFrame, key: str, blocks: list[str], left: str = "k1", right: str = "k2") -> DataFrame:
    """Pairs of rows that agree on the blocking columns, smaller key first."""
    a = df.select(*blocks, F.col(key).alias(left))
    b = df.select(*blocks, F.col(key).alias(right))
    return a.join(b, blocks).filter(F.col(left) < F.col(right)).select(left, right)


def tiled(df: DataFrame, key: str, blocks: list[str], tile: int = TILE) -> DataFrame:
    """df with __n, __tiles, __tile: the rows of its block, into how many tiles it is cut, and the row's own; without a block there is no row."""
    sizes = df.dropna(subset=blocks).groupBy(*blocks).agg(F.count("*").alias("__n")).withColumn("__tiles", F.ceil(F.col("__n") / tile).cast("int"))
    return df.join(F.broadcast(sizes), blocks).withColumn("__tile", F.pmod(F.xxhash64(key), F.col("__tiles")).cast("int"))


def tiled_pairs(df: DataFrame, key: str, blocks: list[str], tile: int = TILE, candidates: int = CANDIDATES, beside: DataFrame | None = None) -> DataFrame:
    """blocks, and all other columns suffixed _1 and _2: pairs of rows that agree on the blocking columns, smaller key first.

    Rows are shuffled, never pairs. A block of over `tile` rows is cut into tiles, each two of which meet in a task, and
    there are as many tasks as the candidates are worth, however few files or bytes the rows are. beside: key, __b and more,
    of what a left row knows of the rows of a tile (see tiled): the pairs have these columns as well.
    """
    sizes = df.dropna(subset=blocks).groupBy(*blocks).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__n"))).first()[0] or 0.0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(total // candidates) + 1)
    large = sizes.filter(F.col("__n") > tile).select(*blocks, F.ceil(F.col("__n") / tile).cast("int").alias("__tiles"))
    rows = df.join(F.broadcast(large), blocks, "left").withColumn("__tiles", F.coalesce("__tiles", F.lit(1)))
    own, all_ = F.pmod(F.xxhash64(key), F.col("__tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1))
    on, rest = [*blocks, "__a", "__b"], [c for c in df.columns if c not in blocks]
    more = [] if beside is None else [c for c in beside.columns if c not in (key, "__b")]

    def side(i: int) -> DataFrame:
        dealt = rows.withColumn("__a" if i == 1 else "__b", own).withColumn("__b" if i == 1 else "__a", all_)
        if i == 1 and beside is not None:
            dealt = dealt.join(beside, [key, "__b"], "left")
        return dealt.select(*on, *[F.col(f"`{c}`").alias(f"{c}_{i}") for c in rest], *(more if i == 1 else [])).repartition(tasks, *on)

    return side(1).hint("merge").join(side(2), on).filter(F.col(f"{key}_1") < F.col(f"{key}_2")).drop("__a", "__b")


def tiled_pairs_with(df: DataFrame, key: str, blocks: list[str], column: str, made: Callable[[Column, Column], Column], name: str, values: int = VALUES) -> DataFrame:
    """tiled_pairs with made(column_1, column_2) as name: while the column has few values, made once for each two of them."""
    distinct = df.select(F.col(column).alias("__value")).distinct()
    n = distinct.limit(values + 1).count()
    if n > values:
        return tiled_pairs(df, key, blocks).withColumn(name, made(F.col(f"{column}_1"), F.col(f"{column}_2")))
    ids = written(distinct.select("__value", (F.row_number().over(W.orderBy("__value")) - 1).cast("long").alias("__id")), "values")
    a, b = (ids.select(F.col("__value").alias(f"__v{i}"), F.col("__id").alias(f"__i{i}")) for i in (1, 2))
    table = a.crossJoin(b).select((F.col("__i1") * n + F.col("__i2")).alias("__both"), made(F.col("__v1"), F.col("__v2")).alias(name))
    coded = df.join(F.broadcast(ids), F.col(column).eqNullSafe(F.col("__value"))).drop("__value")
    pairs = tiled_pairs(coded, key, blocks).withColumn("__both", F.col("__id_1") * n + F.col("__id_2"))
    return pairs.join(F.broadcast(written(table, "values")), "__both").drop("__both", "__id_1", "__id_2")


def coded(df: DataFrame, columns: list[str], values: int = VALUES) -> tuple[DataFrame, dict[str, list]]:
    """df, in which a number __c stands for each of these columns that has few values, and the values of these columns."""
    few = {}
    for c in columns:
        found = [r[0] for r in df.select(c).distinct().limit(values + 1).collect()]
        if len(found) <= values:
            few[c] = found
            ids = _numbers_of(df, c, found, "__value", f"__{c}")
            df = df.join(F.broadcast(ids), F.col(c).eqNullSafe(F.col("__value"))).drop("__value", c)
    return df, few


def _numbers_of(df: DataFrame, column: str, values: list, value: str, number: str) -> DataFrame:
    spark, kind = df.sparkSession, df.schema[column].dataType.simpleString()
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{value}` {kind}, `{number}` long")


def looked_up(pairs: DataFrame, offers: DataFrame, column: str, values: list, made: Callable[[Column, Column], Column]) -> DataFrame:
    """pairs with made(column_1, column_2) as column, made once for each two values, whose numbers (coded) are __column_1 and __column_2."""
    a, b = (_numbers_of(offers, column, values, f"__v{i}", f"__n{i}") for i in (1, 2))
    table = a.crossJoin(b).select((F.col("__n1") * len(values) + F.col("__n2")).alias("__both"), made(F.col("__v1"), F.col("__v2")).alias(column))
    both = F.col(f"__{column}_1") * len(values) + F.col(f"__{column}_2")
    return pairs.withColumn("__both", both).join(F.broadcast(table), "__both").drop("__both", f"__{column}_1", f"__{column}_2")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order, nulls first; rows that tie there may be any of them.

    An aggregate, so that rows of one key are thinned out before they are shuffled. Null keys are keys.
    """
    row, by = F.struct(*[f"`{c}`" for c in df.columns]), F.struct(*[f"`{c}`" for c in order])
    return df.groupBy(*keys).agg(F.min_by(row, by).alias("__r")).select("__r.*")


def mark_duplicates(df: DataFrame, keys: list[str], name: str = "is_duplicate", broadcast_rows: int = BROADCAST_KEYS) -> DataFrame:
    """Whether a row shares its key with another; null keys are keys.

    Keys that repeat are counted first; while they are few they are broadcast, so a common key is no one task's work.
    """
    far = {k: f"__{k}" for k in keys}
    again = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").select(*[F.col(k).alias(v) for k, v in far.items()], F.lit(True).alias("__again"))
    few = again.limit(broadcast_rows + 1).count() <= broadcast_rows
    on = [F.col(k).eqNullSafe(F.col(v)) for k, v in far.items()]
    return df.join(F.broadcast(again) if few else again, on, "left").withColumn(name, F.coalesce("__again", F.lit(False))).drop(*far.values(), "__again")


def numbered(df: DataFrame, group: list[str], by: str, ties: list[str] = (), buckets: int = 1024, name: str = "n") -> DataFrame:
    """df with the number from 1 of each row in its group, by the order of a number `by` (then ties).

    Rows are ranked within ranges of `by` and offset by the counts of the ranges below, so no task sorts a group.
    """
    low, high = df.agg(F.min(by).cast("double"), F.max(by).cast("double")).first()
    width = ((high - low) / buckets or 1.0) if low is not None else 1.0
    at = F.coalesce(F.floor((F.col(by).cast("double") - F.lit(low or 0.0)) / width), F.lit(-1)).cast("int")
    rows = df.withColumn("__at", at)
    counts = rows.groupBy(*group, "__at").agg(F.count("*").alias("__c"))
    before = W.partitionBy(*group).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__at").alias("__range"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(W.partitionBy(*group, "__at").orderBy(by, *ties))
    on = [*[F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col("__at") == F.col("__range")]
    out = rows.withColumn("__rank", rank).join(counts, on).withColumn(name, (F.col("__base") + F.col("__rank")).cast("long"))
    return out.drop("__at", "__rank", "__range", "__base", *[f"__{g}" for g in group])


def join_complete(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """The inner join without columns that hold nothing and without repeated rows."""
    return drop_all_null(df.join(other, on)).distinct()


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", n).filter(F.col("rank") <= k)


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; nulls stay."""
    return df.unpivot(ids, values, variable, value)


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows by the order of a seeded digest of their keys: the same on every run and in every engine."""
    return df.orderBy(digest(keys, seed), *keys).limit(n)


def digest(keys: list[str], seed: int) -> Column:
    """The MD5, in hex digits, of the keys and the seed with '|' between them."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def hash_split(keys: list[str], percent: int, seed: int) -> Column:
    """Whether a row is among the `percent` of a seeded random split."""
    return F.conv(F.substring(digest(keys, seed), 1, 8), 16, 10).cast("long") % 100 < percent


def sorted_pair(a: Column, b: Column) -> Column:
    """Two values of a row in order."""
    return F.array_sort(F.array(a, b))
