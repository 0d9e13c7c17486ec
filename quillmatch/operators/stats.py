"""Profiling: counts, missing values, correlations, five-number summaries, narrowing of types."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.sources.scratch import written


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Non-null values by how often they occur, most often first; ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def group_counts(df: DataFrame, keys: list[str], name: str = "n", keep_nulls: bool = False) -> DataFrame:
    """Rows of each combination of keys; those with a null key are left out unless asked for."""
    return (df if keep_nulls else df.dropna(subset=keys)).groupBy(*keys).agg(F.count("*").alias(name))


def percent_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, percent_null: one pass over the table, then one row per column."""
    columns = columns or df.columns
    one = df.agg(*[(100 * (F.count("*") - F.count(f"`{c}`")) / F.nullif(F.count("*"), F.lit(0))).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "percent_null")


def pairwise(df: DataFrame, columns: dict[str, Column], how) -> DataFrame:
    """a, b, value: an aggregate of every two columns, all in one pass."""
    names = sorted(columns)
    pairs = list(combinations(names, 2))
    one = df.agg(*[how(columns[a], columns[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("value")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's, of every two columns."""
    return pairwise(df, {c: F.col(c).cast("double") for c in columns}, F.corr)


def null_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of the columns' being null; null where a column always or never is."""
    return pairwise(df, {c: F.col(c).isNull().cast("double") for c in columns}, F.corr)


def five_numbers(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """n, min, q1, median, q3, max by group, exactly."""
    out = df.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, value, groups, [0.25, 0.5, 0.75])
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    both = out.join(q.withColumnsRenamed({g: f"__{g}" for g in groups}), on, "left") if groups else out.crossJoin(F.broadcast(q))
    return both.select(*groups, "n", "min", *[F.col("q")[i].alias(x) for i, x in enumerate(("q1", "median", "q3"))], "max")


#: Rows of a range that are ranked as they are; ranges that are broadcast, and the copies of others that rows are dealt to.
RANKED, BROADCAST_RANGES, COPIES = 1_000_000, 100_000, 16


def order_bits(x: Column) -> Column:
    """A whole number for each double but NaN, in their order: equal ones alike, -0.0 as 0.0, infinities outermost.

    It is made of the exponent and the 52 digits of the mantissa, so that neighbouring doubles have neighbouring numbers.
    """
    a = F.abs(x)
    guess = F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022))
    m = a / F.pow(F.lit(2.0), guess.cast("double"))
    exponent = guess + F.when(m >= 2, 1).when(m < 1, -1).otherwise(0)
    mantissa = F.when(m >= 2, m / 2).when(m < 1, m * 2).otherwise(m)
    normal = (exponent + 1023) * F.lit(1 << 52) + ((mantissa - 1) * F.lit(float(1 << 52))).cast("long")
    tiny = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    size = F.when(a < 2.0**-1022, tiny).when(a == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(x < 0, -size).otherwise(size)


def quantiles(df: DataFrame, value: str, groups: list[str], shares: list[float], ranked: int = RANKED) -> DataFrame:
    """groups, q array<double>: exact interpolated quantiles of a number, by group.

    Radix selection: each pass counts the rows of the ranges that hold a sought rank by twelve more of their bits, so six
    passes fix any double; rows of ranges that hold no more than `ranked` of them are ranked as they are. What is known
    of each rank is a table, so there may be any number of groups, and only counts are shuffled of large ranges.
    Null and NaN values count as none; a group without values has nulls. Null groups are groups. Infinities are values:
    a quantile between a number and an infinity is that infinity, one between opposite infinities NaN.
    """
    own = [f"g{i}" for i in range(len(groups))]
    v = F.col(value).cast("double")
    base = df.select(*[F.col(g).alias(o) for g, o in zip(groups, own, strict=True)], F.when(~F.isnan(v), v + 0.0).alias("v"))
    whole = written(base.groupBy(*own).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    base = base.filter("v IS NOT NULL")
    place = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    sought = F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)]))
    ranks = whole.filter("n > 0").select(*own, F.explode(sought).alias("r"), "lo", "hi", F.lit(0).cast("long").alias("below"), "n")
    for shift in (52, 40, 28, 16, 4, 0):
        wide = F.col("lo") < F.col("hi")
        if ranks.filter(wide & (F.col("n") > ranked)).isEmpty():
            break
        open_ = ranks.filter(wide & (F.col("n") > ranked))
        rows = _within(base.withColumn("digits", F.shiftright(order_bits(F.col("v")), shift)), open_, own)
        counts = rows.groupBy(*own, "lo", "digits").agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
        ranks = written(ranks.filter(~(wide & (F.col("n") > ranked))).unionByName(_narrowed(open_, counts, own, "digits")), "ranks")
    open_ = ranks.filter("lo < hi")
    counts = _within(base, open_, own).groupBy(*own, "lo", F.col("v").alias("at")).agg(F.count("*").alias("c")).withColumns({"first": F.col("at"), "last": F.col("at")})
    found = ranks.filter("lo >= hi").unionByName(_narrowed(open_, counts, own, "at"))
    values = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("r", F.col("lo").alias("x")))).alias("values"))
    far = values.withColumnsRenamed({o: f"__{o}" for o in own})
    both = whole.join(far, _same(own), "left") if groups else whole.join(F.broadcast(far), how="left")
    q = F.array(*[_between(F.col("values")[F.floor(p).cast("long")], F.col("values")[F.ceil(p).cast("long")], p - F.floor(p)) for p in place])
    return both.select(*[F.col(o).alias(g) for g, o in zip(groups, own, strict=True)], q.alias("q"))


def _same(own: list[str]) -> list[Column]:
    return [F.col(o).eqNullSafe(F.col(f"__{o}")) for o in own]


def _within(rows: DataFrame, open_: DataFrame, own: list[str]) -> DataFrame:
    """rows (own, v and more) that lie in an open range, with its lo. Ranges that are many meet rows dealt to copies of them."""
    ranges = open_.select(*[F.col(o).alias(f"__{o}") for o in own], "lo", "hi").distinct()
    on = [*_same(own), F.col("v").between(F.col("lo"), F.col("hi"))]
    if not own or ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        return rows.join(F.broadcast(ranges), on)
    copies = ranges.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = F.pmod(F.spark_partition_id(), F.lit(COPIES))
    return rows.withColumn("__own", dealt).join(copies, [*on, F.col("__own") == F.col("__copy")])


def _narrowed(open_: DataFrame, counts: DataFrame, own: list[str], by: str) -> DataFrame:
    """The ranks with the range, among those counted (own, lo, c, first, last), that holds them."""
    upto = counts.withColumn("upto", F.sum("c").over(W.partitionBy(*own, "lo").orderBy(by)))
    far = upto.select(*[F.col(o).alias(f"__{o}") for o in own], F.col("lo").alias("__lo"), "c", "first", "last", "upto")
    rest = F.col("r") - F.col("below")
    hit = open_.join(far, [*_same(own), F.col("lo") == F.col("__lo"), rest < F.col("upto"), rest >= F.col("upto") - F.col("c")])
    return hit.select(*own, "r", F.col("first").alias("lo"), F.col("last").alias("hi"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("n"))


def _between(a: Column, b: Column, share: Column) -> Column:
    """a + (b - a) * share of doubles, a <= b, also where an end or the difference is infinite."""
    inf = float("inf")
    return F.when((a == b) | (share == 0), a).when((a > -inf) & (b < inf) & (b - a == inf), a * (1 - share) + b * share).when((a > -inf) & (b < inf), a + (b - a) * share).otherwise(a + b)


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, median."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return quantiles(long, "value", ["column"], [0.5]).select("column", F.col("q")[0].alias("median"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """value, n, share of all rows with a value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std (sample), min, q1, median, q3, max of numbers."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    five = five_numbers(long, "value", ["column"])
    more = long.groupBy(F.col("column").alias("__c")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return five.join(F.broadcast(more), F.col("column") == F.col("__c")).select("column", "n", "mean", "std", "min", "q1", "median", "q3", "max")


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, distinct, top, freq, low, high of columns of any type, as text: what describe says of all columns.

    top: the value that occurs most often (ties: the first by text), freq: how often. Values are counted by hash
    partitions, and all columns in one pass.
    """
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("c"))
    per = counts.groupBy("column").agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.max("c").alias("freq"), F.min("value").alias("low"), F.max("value").alias("high"))
    top = counts.join(F.broadcast(per.select(F.col("column").alias("__c"), F.col("freq").alias("__f"))), (F.col("column") == F.col("__c")) & (F.col("c") == F.col("__f")))
    top = top.groupBy(F.col("__c")).agg(F.min("value").alias("top"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = every.join(F.broadcast(per), "column", "left").join(F.broadcast(top), F.col("column") == F.col("__c"), "left")
    return out.select("column", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("distinct", F.lit(0)).alias("distinct"), "top", "freq", "low", "high")


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def narrow_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, low, high, kind: the narrowest whole-number type that loses nothing; else double.

    One pass. Unsigned types hold up to, not including, their largest value.
    """
    each = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.coalesce(F.sum(F.abs(F.col(c).cast("double") % 1)), F.lit(1.0)).alias("rest"), (F.count(c) == F.count("*")).alias("full")) for c in columns]
    one = df.agg(*[x.alias(c) for x, c in zip(each, columns, strict=True)])
    rows = one.select(F.inline(F.array(*columns)))
    low, high = F.col("low"), F.col("high")
    whole = F.col("full") & (F.col("rest") == 0)
    unsigned = F.when(high < 255, "uint8").when(high < 65535, "uint16").when(high < 4294967295, "uint32").otherwise("uint64")
    signed = F.when((low > -128) & (high < 127), "int8").when((low > -32768) & (high < 32767), "int16").when((low > -2147483648) & (high < 2147483647), "int32").otherwise("int64")
    return rows.select("column", "low", "high", F.when(~whole, "double").when(low >= 0, unsigned).otherwise(signed).alias("kind"))


def distinct_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, ratio of distinct values to rows; texts below 0.3 are worth a dictionary."""
    return df.agg(*[(F.count_distinct(c) / F.nullif(F.count("*"), F.lit(0))).alias(c) for c in columns]).unpivot([], columns, "column", "ratio")


#: Spark's type for each kind; the unsigned ones take the next wider.
SPARK_TYPES = {"uint8": "short", "uint16": "int", "uint32": "long", "uint64": "decimal(20,0)", "int8": "byte", "int16": "short", "int32": "int", "int64": "long", "double": "double"}


def narrowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with these columns in their narrowest type."""
    kinds = {r["column"]: SPARK_TYPES[r["kind"]] for r in narrow_types(df, columns).collect()}
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c in columns})


def count_zeros(columns: list[str]) -> Column:
    """How many of a row's features are 0, which stands for missing."""
    return sum((F.coalesce(F.col(c) == 0, F.lit(False)).cast("int") for c in columns), F.lit(0))


def ratio_columns(a: Column, b: Column) -> tuple[Column, Column]:
    """abs(a - b), and that over the smaller one (null over 0)."""
    return F.abs(a - b), F.try_divide(F.abs(a - b), F.least(a, b))
