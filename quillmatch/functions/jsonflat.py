"""Flattening of columns that hold an array of JSON objects, within their rows: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.planning import pinned
from quillmatch.functions.text import null_word, strip
from quillmatch.sources.scratch import written

MAPS = "array<map<string,string>>"


def maps(text: Column) -> Column:
    """JSON text as an array of maps; null where it is none."""
    return F.from_json(text, MAPS)


def clean_keys(c: Column) -> Column:
    """Keys without slashes at their ends and with '_' for '.'."""
    return F.transform(c, lambda m: F.transform_keys(m, lambda k, _: F.replace(F.regexp_replace(k, "^/+|/+$", ""), F.lit("."), F.lit("_"))))


def bare(value: Column) -> Column:
    """A value without one bracket at each end, trimmed; the word null is null."""
    return null_word(strip(F.regexp_replace(value, r"^\[|\]$", "")))


def value_of(c: Column, key: str) -> Column:
    """The greatest non-null value of a key, without one bracket at each end, trimmed; the word null is null.

    Keys are matched without slashes at their ends.
    """
    own = F.flatten(F.transform(c, lambda m: F.transform(F.filter(F.map_entries(m), lambda e: F.regexp_replace(e["key"], "^/+|/+$", "") == key), lambda e: e["value"])))
    return bare(F.array_max(F.filter(own, lambda v: v.isNotNull())))


#: Levels of objects that are opened before it is looked whether there are more.
LEVELS = 4

_OBJECT, _OBJECTS = r"^\s*\{", r"^\s*\[\s*\{"


def _path(*keys: Column) -> Column:
    return F.concat_ws(".", *[F.regexp_replace(k, "^/+|/+$", "") for k in keys])


def _entry(path: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), value.alias("value"))


def _inner(e: Column) -> Column:
    """The entries of an object's or an array of objects' text, below its path; null where the text is neither."""
    below = lambda m: F.transform(F.map_entries(m), lambda x: _entry(_path(e["path"], x["key"]), x["value"]))
    one = F.when(e["value"].rlike(_OBJECT), below(F.from_json(e["value"], "map<string,string>")))
    return F.coalesce(one, F.when(e["value"].rlike(_OBJECTS), F.flatten(F.transform(F.from_json(e["value"], MAPS), below))))


def shredded(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column of arrays of maps as one map<string,string> of names and values, whatever depth the JSON has.

    A value that is an object, or an array of objects, is opened; paths are keys without slashes at their ends, joined by
    dots, and a name is a path with '_' for '.'. Of a path's values the greatest counts, without one bracket at each
    end, trimmed; the word null is none. Of paths with the same name the first that has a value counts. There is no
    limit of keys or levels: no key leaves its row. Null, broken and empty arrays: an empty map.
    """
    none = F.array().cast("array<struct<path:string,value:string>>")
    q = {c: F.col(f"`{c}`") for c in columns}
    out = df.withColumns({c: F.coalesce(F.flatten(F.transform(q[c], lambda m: F.transform(F.map_entries(m), lambda x: _entry(_path(x["key"]), x["value"])))), none) for c in columns})
    while True:
        for _ in range(LEVELS):
            out = out.withColumns({c: F.flatten(F.transform(q[c], lambda e: F.coalesce(_inner(e), F.array(e)))) for c in columns})
        more = F.array(*[F.exists(q[c], lambda e: _inner(e).isNotNull()) for c in columns])
        if out.filter(F.array_contains(more, True)).isEmpty():
            break
        out = written(out, "json")
    for step in (_greatest, _first):
        out = out.withColumns({c: pinned(step(q[c])) for c in columns}).withColumns({c: F.filter(q[c], _last(q[c]) if step is _greatest else _new(q[c])) for c in columns})
    return out.withColumns({c: F.map_from_entries(F.transform(q[c], lambda e: F.struct(e["name"], e["value"]))) for c in columns})


def _greatest(c: Column) -> Column:
    """Entries with a value, by path and value."""
    return F.sort_array(F.filter(c, lambda e: e["value"].isNotNull()))


def _last(c: Column):
    """Whether an entry is the last of its path."""
    return lambda e, i: F.coalesce(F.get(c, i + 1)["path"] != e["path"], F.lit(True))


def _first(c: Column) -> Column:
    """Names, paths and clean values that are left, in this order."""
    clean = F.transform(c, lambda e: F.struct(F.replace(e["path"], F.lit("."), F.lit("_")).alias("name"), e["path"].alias("path"), bare(e["value"]).alias("value")))
    return F.sort_array(F.filter(clean, lambda e: e["value"].isNotNull()))


def _new(c: Column):
    """Whether an entry is the first of its name."""
    return lambda e, i: (i == 0) | F.coalesce(F.get(c, i - 1)["name"] != e["name"], F.lit(True))


def key_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, name, n: in how many rows each name of a shredded column has a value."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.map_keys(F.col(f"`{c}`")).alias("names")) for c in columns])
    return df.select(F.inline(each)).select("column", F.explode("names").alias("name")).groupBy("column", "name").agg(F.count("*").alias("n"))


def flatten(df: DataFrame, column: str, keys: list[str], prefix: str = "") -> DataFrame:
    """df with a column for each key (named prefix + key, '_' for '.') in place of the array.

    Of keys that get the same name the first that has a value counts, by their order.
    """
    of: dict[str, list[str]] = {}
    for k in keys:
        of.setdefault(prefix + k.replace(".", "_"), []).append(k)
    return df.withColumns({n: F.coalesce(*[value_of(F.col(f"`{column}`"), k) for k in ks]) for n, ks in of.items()}).drop(column)


def coalesce_gtin(df: DataFrame) -> DataFrame:
    """gtin is the first non-null of the columns whose name holds 'gtin', by name; they are replaced."""
    own = sorted(c for c in df.columns if "gtin" in c)
    if not own:
        return df
    return df.withColumn("__gtin", F.coalesce(*own)).drop(*own).withColumnRenamed("__gtin", "gtin")


def fill_from_parents(df: DataFrame, mark: str = "parent_") -> DataFrame:
    """Each column takes missing values from the parent columns that end with its name; those are dropped.

    A parent column that matches several is used for all and dropped once.
    """
    parents = [c for c in df.columns if c.startswith(mark)]
    children = [c for c in df.columns if not c.startswith(mark)]
    of = {c: [p for p in parents if p.endswith(f"_{c}")] for c in children}
    filled = {c: F.coalesce(c, *ps) for c, ps in of.items() if ps}
    return df.withColumns(filled).drop(*{p for ps in of.values() for p in ps}) if filled else df


__all__ = ["clean_keys", "coalesce_gtin", "fill_from_parents", "flatten", "key_counts", "maps", "shredded", "value_of"]
