"""Benchmark decontamination: windows of normalised benchmark words, looked up in every document.

A document word is hit if it lies inside any occurrence of a benchmark window. The documents are read once and not
shuffled; two small tables of the benchmark go to the tasks as literals of the plan:

1. Word grams of the benchmark. A window of L words covers every gram of L // 2 + 1 words that starts at one of
   its first positions, so a document that holds the window holds such a gram at a position that is a multiple of
   L - L // 2. Only those positions are hashed; this filter loses no document.
2. The windows themselves, by hash, each verified word for word at every position of the documents that are left.

Above MAX_WINDOWS the first step is a shuffled join of grams and the second a shuffled join of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.planning import pinned
from quillmatch.llm.common import ascii_lower
from quillmatch.llm.lookup import Lookup

#: Bytes that are no part of a word, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same bytes in the text as it is; and its words, each with what follows it up to the next word.
RAW = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
LEAD, PIECES = rf"^([{RAW}]+)", rf"[^{RAW}]+[{RAW}]*"

#: Benchmarks of up to so many windows, and so many bytes of windows and item ids, go to the tasks with the plan.
MAX_WINDOWS, MAX_BYTES = 200_000, 32 << 20


def words(text: Column) -> Column:
    """The normalised words; none for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def _gram(ws: Column, start: Column, n: int | Column) -> Column:
    return F.concat_ws(" ", F.slice(ws, (start + 1).cast("int"), n))


def _starts(n_words: Column, n: int, step: int = 1) -> Column:
    """0, step, ... for grams of n words; empty where there are fewer."""
    return F.when(n_words >= n, F.sequence(F.lit(0), (n_words - n).cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """w string, len int, h long, items array<string>: each distinct window and the items that hold it.

    An item of fewer than `window` words, but not none, is one window. A null item_id counts as the item 'null'.
    """
    ws = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words(F.col(text)).alias("ws")).withColumn("n", F.size("ws")).filter("n > 0")
    each = ws.withColumn("len", F.least("n", F.lit(window)))
    each = each.withColumn("p", F.explode(F.sequence(F.lit(0), (F.col("n") - F.col("len")).cast("int"))))
    each = each.select("item", "len", _gram(F.col("ws"), F.col("p"), F.col("len")).alias("w"))
    return each.groupBy("w", "len").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("w"))


def _grams(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """h: hashes of the grams by which documents are filtered."""
    found = None
    for n in lengths:
        g = n // 2 + 1
        ws = windows.filter(F.col("len") == n).select(F.split("w", " ").alias("ws"))
        part = ws.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - g)), lambda p: F.xxhash64(_gram(F.col("ws"), p, g)))).alias("h"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def with_hits(documents: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """documents with __n_words int, __hit array<int> (sorted positions of hit words) and __items array<string>.

    Null and empty texts: no words, no hits. Every row is judged by itself, so repeated rows and repeated or null ids
    need no care. An empty benchmark hits nothing. Other columns pass through, but those whose names are __ws, __hits,
    __hit, __items or __n_words are replaced.
    """
    wins = benchmark_windows(benchmark, window)
    held = F.octet_length("w") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 3) + 40
    sizes = wins.groupBy("len").agg(F.count("*").alias("n"), F.sum(held).alias("bytes")).collect()  # at most `window` rows
    lengths, total, size = sorted(r["len"] for r in sizes), sum(r["n"] for r in sizes), sum(r["bytes"] for r in sizes)
    docs = documents.withColumn("__ws", pinned(words(F.col(text)))).withColumn("__n_words", F.size("__ws"))
    none_i, none_s = F.array().cast("array<int>"), F.array().cast("array<string>")
    if not total:
        return docs.withColumns({"__hit": none_i, "__items": none_s}).drop("__ws")
    if total > max_windows or size > MAX_BYTES:
        return _with_hits_joined(docs, wins, lengths)
    ws, n_words = F.col("__ws"), F.col("__n_words")

    grams = Lookup(_grams(wins, lengths), "h", F.col("h"), "bigint", limit=max_windows * window)
    table = Lookup(wins, "h", F.struct("w", "len", "items"), "struct<w:string,len:int,items:array<string>>", limit=max_windows)

    def holds(n: int) -> Column:
        g = n // 2 + 1
        hashes = F.transform(_starts(n_words, g, n - g + 1), lambda p: F.xxhash64(_gram(ws, p, g)))
        return F.exists(hashes, lambda h: F.array_contains(grams.probe(h), h))

    def hits(n: int) -> Column:
        def at(p: Column) -> Column:
            return F.transform(
                F.filter(F.transform(F.array(_gram(ws, p, n)), lambda w: F.struct(w.alias("w"), table.probe(F.xxhash64(w)).alias("of"))), lambda x: F.size(x["of"]) > 0),
                lambda x: F.struct(p.alias("p"), F.lit(n).alias("len"), F.flatten(F.transform(F.filter(x["of"], lambda e: e["w"] == x["w"]), lambda e: e["items"])).alias("items")),
            )

        return F.filter(F.flatten(F.transform(_starts(n_words, n), at)), lambda x: F.size(x["items"]) > 0)

    some = holds(lengths[0])
    for n in lengths[1:]:
        some = some | holds(n)
    found = F.flatten(F.array(*[hits(n) for n in lengths]))
    docs = docs.withColumn("__hits", F.when(some, found))
    covered = F.flatten(F.transform("__hits", lambda x: F.sequence(x["p"], x["p"] + x["len"] - 1)))
    return docs.withColumns(
        {
            "__hit": F.coalesce(F.array_sort(F.array_distinct(covered)), none_i),
            "__items": F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("__hits", lambda x: x["items"])))), none_s),
        }
    ).drop("__ws", "__hits")


def _with_hits_joined(docs: DataFrame, wins: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark too large to send: joins on hashes, keyed by a checksum of the words."""
    docs = docs.withColumn("__key", F.sha2(F.concat_ws(" ", "__ws"), 256))
    ws, n_words = F.col("__ws"), F.col("__n_words")
    grams, parts = _grams(wins, lengths), []
    for n in lengths:
        g = n // 2 + 1
        parts.append(docs.select("__key", F.explode(F.transform(_starts(n_words, g, n - g + 1), lambda p: F.xxhash64(_gram(ws, p, g)))).alias("h")))
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    keys = seen.join(grams, "h", "left_semi").select("__key").distinct()
    left = docs.join(keys, "__key", "left_semi").dropDuplicates(["__key"])
    every = None
    for n in lengths:
        at = left.select("__key", F.posexplode(F.transform(_starts(n_words, n), lambda p: _gram(ws, p, n))).alias("p", "w")).withColumn("len", F.lit(n))
        every = at if every is None else every.unionByName(at)
    hit = every.join(wins.drop("h"), ["w", "len"]).select("__key", "items", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("len") - 1)).alias("q"))
    per = hit.groupBy("__key").agg(F.array_sort(F.collect_set("q")).alias("__hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"))
    out = docs.join(per, "__key", "left")
    return out.withColumns({"__hit": F.coalesce("__hit", F.array().cast("array<int>")), "__items": F.coalesce("__items", F.array().cast("array<string>"))}).drop("__key", "__ws")


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def report(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; nulls, repeats and empty tables as in with_hits."""
    found = with_hits(documents.select("doc_id", "text"), benchmark, window)
    out = found.select(
        "doc_id",
        F.col("__n_words").cast("long").alias("n_words"),
        F.size("__hit").cast("long").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items").cast("binary"), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words"), share))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, mode: str = "document") -> DataFrame:
    """The documents without contamination, with the columns they came with.

    mode 'document' removes contaminated documents and leaves the others as they are; 'span' keeps every document
    and takes the hit words (with what follows each up to the next word) out of its text.
    """
    found = with_hits(documents, benchmark, window)
    if mode == "document":
        return found.filter(~contaminated(F.size("__hit"), F.col("__n_words"), share)).select(*documents.columns)
    if mode != "span":
        raise ValueError("mode is document or span")
    lead = F.regexp_extract("text", LEAD, 1)
    left = F.filter(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)), lambda x, i: ~F.array_contains("__hit", i))
    cut = F.when(F.size("__hit") > 0, F.concat(lead, F.array_join(left, ""))).otherwise(F.col("text"))
    return found.withColumn("text", cut).select(*documents.columns)


__all__ = ["benchmark_windows", "contaminated", "decontaminate", "report", "with_hits", "words"]
