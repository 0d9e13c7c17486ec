"""A small hash table as one array literal, probed row by row without a join, a shuffle or Python.

The table's entries are gathered once, go into the plan as text, and are folded into one literal, an array of
buckets, when the plan is optimised; a probe reads the one bucket that the key's hash names. For tables of a
checked, bounded size only. (A scalar subquery would do the same, but may not stand in a lambda.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of JSON that a table may have.
MAX_BYTES = 64 << 20


class Lookup:
    def __init__(self, entries: DataFrame, hash_col: str, value: Column, kind: str, limit: int):
        """entries: at most `limit` rows of MAX_BYTES in all, else ValueError, before any of them reaches the driver.

        value: what a probe finds; kind: its type in SQL.
        """
        told = entries.select(F.col(hash_col).alias("h"), F.to_json(F.struct(value.alias("v"))).alias("v"))
        n, size = told.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()
        if n > limit or size > MAX_BYTES:
            raise ValueError(f"a lookup table of {n} entries and {size} bytes; {limit} and {MAX_BYTES} are allowed")
        rows = told.collect()
        self.n = max(16, min(1 << 20, len(rows) // 2))
        buckets: list[list[str]] = [[] for _ in range(self.n)]
        for h, v in sorted(rows):
            buckets[h % self.n].append(v[5:-1])
        text = "[" + ",".join("[" + ",".join(b) + "]" for b in buckets) + "]"
        self.literal = F.from_json(F.lit(text), f"array<array<{kind}>>")

    def probe(self, key_hash: Column) -> Column:
        """The values whose key may have this hash; an empty array where there are none."""
        return F.element_at(self.literal, (F.pmod(key_hash, F.lit(self.n)) + 1).cast("int"))


__all__ = ["Lookup"]
