"""Quarantine and cascading release of conversation turns: a replay of failing deliveries.

Turns arrive in order, and a turn may depend on one up to `span` turns before it. A faulty turn is quarantined, tried
again until it is repaired, and given up after some failures; what depends on it waits, or is blocked for good. What
is delivered is numbered by its time of delivery, and a checksum of the released text grows with each number.

Turns are dealt by conversation and piece of a conversation and sorted by place; an iterator over them keeps no more
than the outcomes of the last `span` turns. A piece that needs outcomes of the piece before it is replayed once these
are known, so a conversation of any length is many tasks' work. Places, release numbers and the checksum are prefix
sums over buckets of at most 256 members, level by level: no task, broadcast or driver holds a whole conversation.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.llm.common import drop_table, written

#: Turns of a piece; a bucket of places has as many turn numbers, one of deliveries 2 ** SECONDS seconds.
PIECE, SECONDS = 64, 9

#: Members of a group of prefix sums: 2 ** FAN.
FAN = 8

OUTCOME = "status string, attempts int, first_at long, last_at long"


@dataclass(frozen=True)
class Law:
    """When turns arrive, what they depend on, and which of their attempts fail: digests of k, conversation and turn."""

    interval: int = 7
    span: int = 4
    wait: int = 10
    tries: int = 6

    def digest(self, k: int, conv_id: int, turn: int) -> int:
        return zlib.crc32(b"%d:%d:%d" % (k, conv_id, turn))

    def distance(self, conv_id: int, turn: int) -> int:
        """Turns back to the parent; 0: none."""
        return self.digest(0, conv_id, turn) % (self.span + 1)

    def repair(self, conv_id: int, turn: int) -> int | None:
        """Seconds from arrival to repair; None: not faulty."""
        return self.digest(2, conv_id, turn) % 101 if self.digest(1, conv_id, turn) % 101 < 50 else None

    def unlucky(self, conv_id: int, turn: int, attempt: int) -> bool:
        """Whether this attempt of a faulty turn fails even after its repair."""
        return self.digest(attempt + 2, conv_id, turn) % 3 == 0

    def outcome(self, conv_id: int, turn: int, arrival: int, start: int) -> tuple[str, int, int, int]:
        """status, attempts, first_at, last_at of a turn whose first attempt is at start."""
        repair, at = self.repair(conv_id, turn), start
        for attempt in range(1, self.tries + 1):
            if repair is None or not (at < arrival + repair or self.unlucky(conv_id, turn, attempt)):
                return "delivered", attempt, start, at
            if attempt < self.tries:
                at += self.wait << (attempt - 1)
        return "dead", self.tries, start, at


def replay(turns: DataFrame, law: Law = Law(), piece: int = PIECE) -> DataFrame:
    """conv_id, turn, status, attempts, first_at, last_at, release_no, state, place: one row for each turn.

    turns: conv_id, turn, text; other columns are not read. Rows of the same conv_id and turn are one turn, with the
    text of the smallest checksum. Null text: empty. Rows without a conv_id or a turn number have no place: one
    row for each such key, with nulls. Deliveries at the same second: by turn. Empty table: no rows. state is kept
    modulo 2 ** 64, as a signed number. The law's interval must be positive.
    """
    if law.interval < 1:
        raise ValueError("turns must not all arrive at once")
    checksum = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    one = written(turns.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).agg(F.min(checksum).alias("text_crc32")), "turns")
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    outcomes = _settled(numbered(one.filter(whole)), law, piece)
    out = _released(outcomes)
    lost = one.filter(~whole).select("conv_id", "turn", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns[2:]])
    return out.unionByName(lost)


def feed(turns: DataFrame, law: Law = Law()) -> DataFrame:
    """conv_id, release_no, turn, released_at, text, state: the delivered texts; sorted by the first two, the released stream."""
    out = replay(turns, law).filter("status = 'delivered'").withColumnRenamed("last_at", "released_at")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).agg(F.min_by(text, F.crc32(text.cast("binary"))).alias("text"))
    return out.join(texts, ["conv_id", "turn"]).select("conv_id", "release_no", "turn", "released_at", "text", "state")


def before(df: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """df with before_<value>: sums over the rows of the same key and a smaller `at`, a whole number that is unique to a key.

    Level by level: within groups of 2 ** FAN neighbouring numbers (at the top two of them), then of the groups' sums. df is read several times.
    """
    low, high = df.agg(F.min(at), F.max(at)).first()

    def level(d: DataFrame, low: int, high: int) -> DataFrame:
        up = d.withColumn("__up", F.shiftright(at, FAN))
        top = (high >> FAN) - (low >> FAN) <= 1  # numbers below and from 0 never meet in one group
        w = W.partitionBy(key, *[] if top else ["__up"]).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        own = up.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(w), F.lit(0)).cast(dict(df.dtypes)[v]) for v in values})
        if top:
            return own.drop("__up")
        sums = up.groupBy(key, "__up").agg(*[F.sum(v).cast(dict(df.dtypes)[v]).alias(v) for v in values]).withColumnRenamed("__up", at)
        tops = level(written(sums, "sums"), low >> FAN, high >> FAN).select(F.col(key).alias("__key"), F.col(at).alias("__at"), *[F.col(f"before_{v}").alias(f"__{v}") for v in values])
        both = own.join(tops, (F.col(key) == F.col("__key")) & (F.col("__up") == F.col("__at")))
        return both.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"__{v}") for v in values}).select(*df.columns, *[f"before_{v}" for v in values])

    return level(df, low or 0, high or 0)


def numbered(turns: DataFrame) -> DataFrame:
    """turns with place: 0, 1, ... of each conversation by turn. conv_id and turn are unique and not null."""
    bucket = F.shiftright("turn", PIECE.bit_length() - 1)
    counts = written(turns.groupBy("conv_id", bucket.alias("bucket")).agg(F.count("*").alias("n")), "buckets")
    base = before(counts, "conv_id", "bucket", ["n"]).select("conv_id", "bucket", "before_n")
    own = F.row_number().over(W.partitionBy("conv_id", "bucket").orderBy("turn")) - 1
    return turns.withColumn("bucket", bucket).join(base, ["conv_id", "bucket"]).withColumn("place", F.col("before_n") + own).drop("bucket", "before_n")


def _settled(turns: DataFrame, law: Law, piece: int) -> DataFrame:
    """turns (conv_id, turn, place, text_crc32) with the outcome of each, as a table in the shared folder."""
    unknown = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in OUTCOME.split(", "))]
    at = F.floor(F.col("place") / piece).cast("long").alias("piece")
    now = written(_replayed(turns.select("conv_id", "turn", "place", "text_crc32", *unknown, at, F.lit(False).alias("told")), law), "outcomes")
    while not (open_ := now.filter("status IS NULL").select("conv_id", at)).isEmpty():
        open_ = open_.distinct()
        tail = now.filter(F.col("place") % piece >= piece - law.span).withColumns({"piece": F.floor(F.col("place") / piece).cast("long") + 1, "told": F.lit(True)})
        again = now.withColumns({"piece": at, "told": F.lit(False)}).unionByName(tail).join(open_, ["conv_id", "piece"], "left_semi")
        rest = now.withColumn("piece", at).join(open_, ["conv_id", "piece"], "left_anti").drop("piece")
        last, now = now, written(rest.unionByName(_replayed(again.select(*now.columns, "piece", "told"), law)), "outcomes")
        drop_table(last)
    return now


def _replayed(rows: DataFrame, law: Law) -> DataFrame:
    """rows with outcomes where they follow from what is known; those that were only told, from the piece before, go."""
    kind = f"conv_id long, turn long, place long, text_crc32 long, {OUTCOME}"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in kind.split(", ")]
        schema = pa.schema(list(zip(names, types, strict=True)))
        ring, key = deque(maxlen=law.span), None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                out = []
                for conv, turn, place, crc, status, attempts, first, last, piece, told in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if key != (conv, piece):
                        key = conv, piece
                        ring.clear()
                    found = (status, attempts, first, last)
                    if status is None:
                        found = _outcome(law, ring, conv, turn, place)
                    ring.append((place, found[0], found[3]))
                    if not told:
                        out.append((conv, turn, place, crc, *found))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)

    # by a digest: a union of joins by the two columns would count as dealt by them, and may not be once its parts are coalesced
    return rows.repartition(F.xxhash64("conv_id", "piece")).sortWithinPartitions("conv_id", "piece", "place").mapInArrow(run, kind)


def _outcome(law: Law, ring: deque, conv: int, turn: int, place: int) -> tuple:
    """The outcome of a turn after those in the ring; nulls where its parent's is not known yet."""
    arrival = start = law.interval * place
    distance = law.distance(conv, turn)
    if 0 < distance <= place:
        parent, status, last = ring[-distance] if distance <= len(ring) else (None, None, None)
        if parent != place - distance or status is None:
            return None, None, None, None
        if status != "delivered":
            return "blocked", 0, None, None
        start = max(arrival, last)
    return law.outcome(conv, turn, arrival, start)


def _released(outcomes: DataFrame) -> DataFrame:
    """outcomes with release_no and state, by the time of delivery and turn."""
    big = "decimal(38,0)"
    w = W.partitionBy("conv_id", "bucket").orderBy("last_at", "turn").rowsBetween(W.unboundedPreceding, 0)
    own = outcomes.filter("status = 'delivered'").withColumn("bucket", F.shiftright("last_at", SECONDS)).withColumn("own", F.row_number().over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    own = own.withColumns({"sum": F.sum("text_crc32").over(w), "weighed": F.sum(F.col("own") * F.col("text_crc32")).over(w)})
    own = written(own, "deliveries")
    sums = own.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"), F.max("sum").alias("sum"), F.max("weighed").alias("weighed"))
    counted = written(before(written(sums, "buckets"), "conv_id", "bucket", ["n"]), "buckets")
    grown = counted.withColumn("grown", (F.col("before_n").cast(big) * F.col("sum") + F.col("weighed")).cast(big))
    base = before(grown, "conv_id", "bucket", ["grown"]).select("conv_id", "bucket", "before_n", "before_grown")
    state = F.col("before_grown") + F.col("before_n").cast(big) * F.col("sum") + F.col("weighed")
    done = own.join(base, ["conv_id", "bucket"]).withColumns({"release_no": F.col("before_n") + F.col("own"), "state": _wrapped(state.cast(big))})
    rest = outcomes.filter("status <> 'delivered'").withColumns({"release_no": F.lit(None).cast("long"), "state": F.lit(None).cast("long")})
    names = ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state", "place"]
    return done.select(*names).unionByName(rest.select(*names))


def _wrapped(c: Column) -> Column:
    """A whole number modulo 2 ** 64, as a signed long."""
    half, full = F.expr(f"{1 << 63}BD"), F.expr(f"{1 << 64}BD")
    return F.when(c.between(-half, half - F.lit(1)), c).otherwise(F.pmod(c + half, full) - half).cast("long")
