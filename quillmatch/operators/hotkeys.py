"""Joins by keys of which some have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is broadcast, at most; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Keys of more rows than HOT are joined apart: broadcast if they are few, else in SALTS parts.
HOT, SALTS = 256, 64


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined_by_hot_keys(rows: DataFrame, of: DataFrame, keys: list[str], hot: int = HOT, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the other columns of `of` by keys, a left join; n in `of` counts a key's rows, and goes.

    No key's rows meet in one task: those of keys with more than `hot` rows are joined to a broadcast table of these
    keys, or, where even these are more than `most`, to SALTS copies of each. Null keys find nothing.
    """
    mine = [c for c in of.columns if c not in (*keys, "n")]
    far, new = ({c: fresh(rows, f"__{c}") for c in names} for names in (keys, mine))
    is_large, part, columns = fresh(rows, "__large"), fresh(rows, "__part"), [F.col(f"`{c}`") for c in rows.columns]
    large = of.filter(F.col("n") > hot).select(*[F.col(c).alias(v) for c, v in (far | new).items()], F.lit(True).alias(is_large))
    on = [F.col(k) == F.col(v) for k, v in far.items()]
    if large.limit(most + 1).count() <= most:
        first = rows.join(F.broadcast(large), on, "left")
    else:
        salted = large.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        first = rows.join(salted, [*on, F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int") == F.col(part)], "left").drop(part)
    named = [F.col(v).alias(c) for c, v in new.items()]
    found = first.filter(F.col(is_large)).select(*columns, *named)
    small = of.filter(F.col("n") <= hot).select(*[F.col(c).alias(v) for c, v in (far | new).items()])
    rest = first.filter(F.col(is_large).isNull()).select(*columns).join(small, on, "left").select(*columns, *named)
    return found.unionByName(rest)
