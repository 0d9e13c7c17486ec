"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest run of turns that both conversations begin with is rendered once, as the prompt; what follows in each is
its completion. A completion's mask says which characters are trained on: the text and the end mark of its assistant
turns. All in column expressions, and each turn is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the chat markup; in a turn's own text and role their opening is broken by a space, so that neither
#: can forge a turn. Line breaks in a role become spaces, since a role ends at the first.
OPEN, SHUT, FORGED, BROKEN = "<|im_start|>", "<|im_end|>", "<|im_", "< |im_"

TURN = "struct<turn:long,role:string,text:string>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<turn, role, text>>: each conversation's turns in order.

    A conversation is one row from here on, as it is one example in the end. Repeated turns count once; turns of the
    same number follow each other by role and text. A null number comes first, a null role is 'unknown', a null text
    empty; turns without a conv_id belong to no conversation. Other columns are not read.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    slim = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    return slim.groupBy("conv_id").agg(F.sort_array(F.array_distinct(F.collect_list("t"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Turns that both begin with: same role, same text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(F.translate(t["role"], "\r\n", "  "), F.lit(FORGED), F.lit(BROKEN)), F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(F.replace(t["text"], F.lit(FORGED), F.lit(BROKEN)), F.lit(SHUT))


def render(turns: Column) -> Column:
    """The turns in chat markup."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def trained_spans(turns: Column, role: str = "assistant") -> Column:
    """array<struct<start, length>>: characters of the rendered turns to train on, in order."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(_body(t))
        span = F.struct((acc["at"] + head).alias("start"), body.alias("length"))
        return F.struct((acc["at"] + head + body + 1).alias("at"), F.when(t["role"] == role, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, and chosen_spans and rejected_spans into the completions.

    pairs: pair_id, chosen and rejected, both arrays of turns (null: empty). Equal sides have empty completions, sides
    with nothing in common an empty prompt. Rows are formatted each by itself.
    """
    none = F.array().cast(f"array<{TURN}>")
    both = pairs.select("pair_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    both = both.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    n, sides = F.col("prompt_turns"), {}
    for side in ("chosen", "rejected"):
        rest = F.slice(F.col(side), n + 1, F.greatest(F.size(side) - n, F.lit(0)))
        sides |= {side: render(rest), f"{side}_spans": trained_spans(rest)}
    prompt = render(F.slice("chosen", F.lit(1), n))
    return both.select("pair_id", "prompt_turns", prompt.alias("prompt"), *[c.alias(k) for k, c in sides.items()])


def answer_swaps(convs: DataFrame, role: str = "assistant") -> DataFrame:
    """pair_id, chosen, rejected: each conversation against itself with its last answer taken from its neighbour.

    The neighbour of 2 k is 2 k + 1 and the other way round; where it has no answer, the rejected side lacks the last
    one. A conversation without an answer equals its rejected side.
    """
    ask = F.filter("turns", lambda t: t["role"] == role)
    own = convs.withColumn("last", F.try_element_at(ask, F.lit(-1)))
    other = own.filter(F.col("last").isNotNull()).select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last")["text"].alias("answer"))
    both = own.join(other, "conv_id", "left")
    put = F.transform("turns", lambda t: F.when(t == F.col("last"), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("answer").alias("text"))).otherwise(t))
    cut = F.filter("turns", lambda t: F.col("last").isNull() | (t != F.col("last")))
    rejected = F.when(F.col("answer").isNotNull() & F.col("last").isNotNull(), put).otherwise(cut)
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def spans_text(spans: Column) -> Column:
    """start:length,... as text."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
