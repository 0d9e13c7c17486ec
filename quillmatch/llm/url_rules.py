"""URL filtering by association rules.

Spark's FP-growth mines combinations of URL tokens from labelled pages. Tokens that are on the same labelled pages say
the same and are mined as one item, so that tokens which always go together make no exponential number of itemsets.
Rules whose consequent is the unwanted class are kept if support and confidence suffice and if the confidence is above
the base rate beyond chance (a bound that holds at every number of labelled pages); less general ones that a more
general rule covers are pruned. A page is judged through an inverted index: each rule hangs on its rarest item, and
only the rules of a page's own items are tested. Rules given by hand (host and path) come first.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import LOWER, UPPER, fresh, joined_by_hot_keys
from quillmatch.llm.lookup import Lookup

#: The item that stands for the unwanted class; no URL token starts like it.
BAD = "class=bad"

#: Up to so many mined rules go to the tasks with the plan; more are joined.
MAX_RULES = 100_000

#: Normal deviations by which a rule's confidence lies above the base rate: some thousand chance rules are tried.
DEVIATIONS = 4.0

RULES = "antecedent array<string>, hits long, pages long, confidence double, support double"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; empty for null or without '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty for null or without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct items: host labels, path words and query keys, in lower case. Parts that are only digits are none."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    parts = F.concat(
        F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h="), x)),
        F.transform(F.split(F.translate(path_of(url), UPPER, LOWER), r"[/.\-_]+"), lambda x: F.concat(F.lit("p="), x)),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q="), F.regexp_extract(x, "^([^=]*)", 1))),
    )
    return F.array_distinct(F.filter(parts, lambda x: ~x.rlike(r"^.=\d*$")))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    """The rule's host itself or a subdomain, and a path that starts with the rule's."""
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def least_confidence(hits: Column, pages: Column, deviations: float) -> Column:
    """Wilson's lower bound of the share hits / pages."""
    n, z = pages.cast("double"), deviations
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def token_classes(tokens: DataFrame, least: int) -> DataFrame:
    """t, item: tokens of at least `least` of the rows (items array), and the first of those that are on the same rows.

    Rows are told apart by hashes of what they hold, each summed up in two halves. There are at most tokens a row
    times rows / least of them.
    """
    h = F.col("h")
    halves = [F.sum(F.pmod(x, F.lit(1 << 31))).alias(c) for c, x in (("s1", h), ("s2", F.shiftright(h, 31)))]
    each = tokens.select(F.xxhash64("items").alias("h"), F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("n"), *halves)
    each = each.filter(F.col("n") >= least)
    first = each.groupBy("n", "s1", "s2").agg(F.min("t").alias("item"))
    return each.join(first, ["n", "s1", "s2"]).select("t", "item")


class Items:
    """Tokens as the items that stand for them; tokens without one are left out."""

    def __init__(self, classes: DataFrame):
        self._lookup = Lookup(classes.withColumn("h", F.xxhash64("t")), "h", F.struct("t", "item"), "struct<t:string,item:string>", limit=1_000_000)

    def of(self, tokens: Column) -> Column:
        found = F.transform(tokens, lambda t: F.transform(F.filter(self._lookup.probe(F.xxhash64(t)), lambda e: e["t"] == t), lambda e: e["item"]))
        return F.array_distinct(F.flatten(found))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int = 6, deviations: float = DEVIATIONS) -> tuple[DataFrame, Items]:
    """antecedent array<string>, hits, pages, confidence, support: pruned rules for the unwanted class; and the items.

    labelled: url, bad; every row counts, repeated ones as often. hits: bad rows that hold the antecedent; pages: all
    that do. A rule needs hits on min_support of the rows, hits / pages of min_confidence, and a lower bound of that
    share, `deviations` below it, above the share of all rows; the fewest hits with which a rule can pass that bound
    are what is mined for. Antecedents have at most max_tokens items; those of one item are always within. A rule is
    pruned if its antecedent holds that of a shorter rule of at least its confidence. Null urls have no tokens, null
    labels are not bad. No rows, none bad or all bad: no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.select(tokens_of(F.col("url")).alias("items"), F.coalesce("bad", F.lit(False)).alias("bad"))
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    base = bad / max(1, total)
    least = max(1, ceil(min_support * total), floor(deviations**2 * base / (1 - base)) + 1 if base < 1 else total)
    items = Items(token_classes(rows, least))
    if base in (0, 1) or least > bad:
        return spark.createDataFrame([], RULES), items
    held = rows.select(items.of(F.col("items")).alias("items"), "bad")
    held = held.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")).filter(F.size("items") > 0)
    n = held.count()
    # half a row below the least, whatever the rounding of the product
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(held).associationRules
    hits, pages = F.round(F.col("support") * n).cast("long"), F.round(F.col("support") * n / F.col("confidence")).cast("long")
    rules = found.filter(F.array_contains("consequent", BAD) & (F.size("antecedent") <= max_tokens)).select(F.array_sort("antecedent").alias("antecedent"), hits.alias("hits"), pages.alias("pages"))
    rules = rules.filter((F.col("hits") / F.col("pages") >= min_confidence) & (least_confidence(F.col("hits"), F.col("pages"), deviations) > base))
    rules = rules.select("antecedent", "hits", "pages", (F.col("hits") / F.col("pages")).alias("confidence"), (F.col("hits") / F.lit(total)).alias("support"))
    return pruned(rules), items


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those whose antecedent holds another one's of at least their confidence."""
    masks = F.sequence(F.lit(1), F.expr("shiftleft(1, size(antecedent)) - 2"))
    part = F.filter("antecedent", lambda t, i: F.getbit("mask", i) == 1)
    parts = rules.filter(F.size("antecedent") > 1).select("antecedent", "confidence", F.explode(masks).alias("mask")).select("antecedent", "confidence", part.alias("part"))
    covered = parts.join(rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("general")), "part").filter("general >= confidence")
    return rules.join(covered.select("antecedent").distinct(), "antecedent", "left_anti")


def _keyed(rules: DataFrame) -> DataFrame:
    """key, antecedent, confidence: each rule under the item of its antecedent that the fewest rules have."""
    use = rules.select(F.explode("antecedent").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    each = rules.select("antecedent", "confidence", F.explode("antecedent").alias("t")).join(use, "t")
    return each.groupBy("antecedent", "confidence").agg(F.min(F.struct("n", "t"))["t"].alias("key"))


def with_confidence(pages: DataFrame, rules: DataFrame, items: Items, max_rules: int = MAX_RULES) -> DataFrame:
    """pages with mined_confidence: the highest of a rule whose antecedent the url's items hold; null if none does.

    Up to max_rules rules are an inverted index in the plan. More are joined by their rarest item with the distinct
    sets of items, whose results come back without one common set meeting in one task.
    """
    keyed, own = _keyed(rules), items.of(tokens_of(F.col("url")))
    holds = lambda of, antecedent: F.size(F.array_except(antecedent, of)) == 0
    if rules.limit(max_rules + 1).count() <= max_rules:
        index = Lookup(keyed.withColumn("h", F.xxhash64("key")), "h", F.struct("antecedent", "confidence"), "struct<antecedent:array<string>,confidence:double>", limit=max_rules)
        near = F.flatten(F.transform(own, lambda t: index.probe(F.xxhash64(t))))
        return pages.withColumn("mined_confidence", F.array_max(F.transform(F.filter(near, lambda r: holds(own, r["antecedent"])), lambda r: r["confidence"])))
    group, one = fresh(pages, "__set"), fresh(pages, "__own")
    told = pages.withColumn(group, F.sha2(F.array_join(F.array_sort(own), "\n"), 256))
    sets = told.withColumn(one, own).groupBy(group).agg(F.first(one).alias("own"), F.count("*").alias("n"))
    near = sets.select(group, "own", F.explode("own").alias("key")).join(keyed, "key").filter(holds(F.col("own"), F.col("antecedent")))
    best = near.groupBy(group).agg(F.max("confidence").alias("mined_confidence"))
    return joined_by_hot_keys(told, sets.select(group, "n").join(best, group), [group]).drop(group)


def judge(pages: DataFrame, labelled: DataFrame, given: list[tuple[str, str, str]], min_support: float = 0.002, min_confidence: float = 0.6, max_rules: int = MAX_RULES) -> DataFrame:
    """pages with host, path, rule (of those given, else null), mined_confidence and verdict (allow or block).

    given: (verdict, host, path); the longest that fits wins, and the mined rules judge the rest: block if one
    matches. labelled: url, bad, as in mine_rules. Each row is judged by itself: repeated rows, null ids and other
    columns pass through; columns of pages with the names of the new ones are replaced. An empty table has no rows.
    """
    rules, items = mine_rules(labelled, min_support, min_confidence)
    told = pages.drop("host", "path", "rule", "mined_confidence", "verdict")
    out = with_confidence(told, rules, items, max_rules).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = verdict = None
    for kind, host, path in sorted(given, key=lambda r: (-len(r[1] + r[2]), r)):
        at = fits(F.col("host"), F.col("path"), host, path)
        rule = F.when(at, host + path) if rule is None else rule.when(at, host + path)
        verdict = F.when(at, kind) if verdict is None else verdict.when(at, kind)
    mined = F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow")
    return out.withColumns({"rule": F.lit(None).cast("string") if rule is None else rule, "verdict": mined if verdict is None else verdict.otherwise(mined)})
