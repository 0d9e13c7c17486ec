"""Text and number cleaning as column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmatch.schemas import PAIR_CATEGORIES


def strip(c: Column) -> Column:
    """Without white space (not only spaces) at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def domain(url: Column) -> Column:
    """Network location with user and port; empty where there is none."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)


def pretty_domain(c: Column) -> Column:
    """Every 'www.' and 'de.' is deleted, wherever it stands."""
    return F.regexp_replace(c, r"www\.|de\.", "")


def parse_price(c: Column) -> Column:
    """Letters, quotes and commas go; two last digits after a space are cents; what is no number then is null."""
    bare = strip(F.regexp_replace(c, '[a-zA-Z",]+', ""))
    return F.regexp_replace(F.regexp_replace(bare, r" (\d\d)$", ".$1"), r"\s+", "").try_cast("double")


def parse_price_spaced(c: Column) -> Column:
    """The older reading: currency words and commas go, a space is the decimal point."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "usd|gbp|,", ""), " ", ".").try_cast("double")


def fix_name(c: Column) -> Column:
    """Without a 'null' that was joined on with a comma."""
    return F.regexp_replace(c, r"^null\s*?,|,\s*?null$", "")


def fix_description(c: Column) -> Column:
    """Without a leading 'description'."""
    return F.regexp_replace(c, "^description", "")


#: Listed one by one: a class of single characters is looked up in a table, one of ranges is compared range by range.
_KEPT = "abcdefghijklmnopqrstuvwxyz0123456789 "


def clean_text(c: Column) -> Column:
    """Tags go, lower case, runs of other characters become a space, single ones and language marks go.

    By the last step only letters, digits and spaces are left, so what stands around a language mark is a space.
    """
    tagless = F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, "(?d)<.*?>", "")).otherwise(c)
    steps = [(f"[^{_KEPT}][^{_KEPT}]+", " "), (f"[^{_KEPT}]", ""), (" (?:en|enus) ", "")]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.lower(tagless))


def file_category(c: Column, categories: list[str] = PAIR_CATEGORIES) -> Column:
    """The last of the categories whose word is in the name; null for none."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(x)), x) for x in reversed(categories)])


def dataset_of(filename: Column) -> Column:
    """'train', else 'test' for gold-standard files, else null."""
    return F.when(F.contains(filename, F.lit("train")), "train").when(F.contains(filename, F.lit("gs_")), "test")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def char_count(c: Column) -> Column:
    return F.length(c)


def prefix(c: Column, n: int = 25) -> Column:
    return F.substring(c, 1, n)


def offer_id(node: Column, url: Column) -> Column:
    """node and url with a space; null if either is."""
    return F.concat(node, F.lit(" "), url)


def url_of(offer: Column) -> Column:
    """What follows the first space."""
    return F.get(F.split(offer, " ", 2), 1)


def null_word(c: Column, word: str = "null") -> Column:
    """Null where the value is just this word."""
    return F.nullif(c, F.lit(word))


def number_text(c: Column) -> Column:
    """A double as people write it, also from ten million on: 12345678.0, never 1.2345678E7."""
    return F.when(F.abs(c) >= 1e7, F.concat(F.regexp_replace(F.format_string("%.4f", c), r"0{1,3}$", ""))).otherwise(c.cast("string"))


def joined_document(texts: list[Column], price: Column) -> Column:
    """All attributes of an offer as one text, without the nulls among them."""
    return F.concat_ws(" ", *texts, number_text(price))


def class_name(label: Column) -> Column:
    return F.concat(F.lit("X"), label.cast("string"))


def tokens(c: Column) -> Column:
    """Lower-case words of two letters, digits (of any script) or underscores or more; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(words: Column, low: int = 1, high: int = 3) -> Column:
    """All runs of low to high words, joined by a space, with repeats."""

    def of(n: int) -> Column:
        last = F.size(words) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)))

    return F.concat(*[words if n == 1 else of(n) for n in range(low, high + 1)])
