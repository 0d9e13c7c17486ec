"""Training-order materialisation: every sequence gets a global slot, and shards of fixed stride hold them in order.

A keyed Feistel network permutes a power of four at least as large as the number of sequences; cycle-walking applies
it again to what falls outside, so it permutes exactly 0 .. n - 1. The order needs no sort key, no shuffle buffer and
no table: anyone with the key can tell the slot of a sequence, and the sequence of a slot.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.llm import store
from quillmatch.llm.common import BROADCAST_IDS, drop_path, scratch, written
from quillmatch.llm.tokens import as_batches, texts_of, worker_tokenizer

#: Ids are little-endian unsigned 16-bit; the vocabulary's end-of-text id ends documents and fills up sequences.
END, WIDTH = 49407, 2

ROUNDS = 6
#: The three constants of the splitmix64 mixer.
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def _round_keys(key: int) -> list[np.uint64]:
    return list(_mix(np.arange(ROUNDS, dtype=np.uint64) + _mix(np.array([key % 2**64], np.uint64))))


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slots of indices below n, or with inverse the indices of slots."""
    bits = np.uint64(_half_bits(n))
    low = np.uint64((1 << int(bits)) - 1)
    keys = _round_keys(key)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> bits, x & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (_mix(right ^ k) & low)
        out[todo] = (left << bits) | right
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def sequences(documents: DataFrame, length: int, path: str | None = None) -> DataFrame:
    """part, i, n_tokens, doc_ids, ids binary: each partition's documents on end, cut every `length` ids.

    doc_ids are those with an id in the sequence, in order. Null and empty texts leave their separator alone.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("part", pa.int64()), ("i", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary())])
        yield from as_batches(rows(batches, TaskContext.get().partitionId()), schema, 256)

    def rows(batches, part):
        tokenizer, end = worker_tokenizer(path, specials_as_text=True), np.array([END], np.uint32)
        held, docs, n, i = [], [], 0, 0
        for doc_id, text in texts_of(batches):
            ids = np.concatenate([tokenizer.ids(text), end]).astype("<u2")
            while len(ids):
                take = ids[: length - n]
                held.append(take)
                docs.append(doc_id)
                n, ids = n + len(take), ids[len(take) :]
                if n == length:
                    yield part, i, n, docs, np.concatenate(held).tobytes()
                    held, docs, n, i = [], [], 0, i + 1
        if n:
            yield part, i, n, docs, np.concatenate(held).tobytes()

    slim = documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string"))
    return slim.mapInArrow(run, "part long, i long, n_tokens long, doc_ids array<long>, ids binary")


def materialise(documents: DataFrame, folder: str, key: int, length: int = 2048, shard_sequences: int = 8192, path: str | None = None) -> DataFrame:
    """Writes the shards and their manifest.json; returns sequence, slot, shard, offset, n_tokens, ids_crc32, doc_ids.

    sequence: its number before the permutation; slot: its place in training order; slot // shard_sequences is its
    shard and offset its byte there. Each partition of the last stage is one range of slots and writes one shard,
    strictly in order; a lost task writes its shard anew. Repeated rows are separate documents, null ids stay null.
    No documents: no sequences, and a manifest that says so. Only doc_id and text are read.
    """
    spark, made = documents.sparkSession, scratch(documents.sparkSession, "sequences")
    store.make_dir(folder)
    # ids are most of what lies on disk until the shards are written, so they are packed tightly
    packed = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
    sequences(documents, length, path).write.options(**packed).parquet(made)
    cut = spark.read.schema("part long, i long, n_tokens long, doc_ids array<long>, ids binary").parquet(made)
    parts = cut.groupBy("part").agg(F.count("*").alias("n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # one row for each input partition: few, whatever they hold
    base = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    stride, shards = length * WIDTH, max(1, -(-total // shard_sequences))

    def place(batches):
        import pyarrow as pa

        for b in batches:
            number = b.column("base").to_numpy() + b.column("i").to_numpy()
            slot = permute(number, total, key)
            cols = [pa.array(number), pa.array(slot), pa.array((slot // shard_sequences).astype(np.int32)), b.column("n_tokens"), b.column("doc_ids"), b.column("ids")]
            yield pa.RecordBatch.from_arrays(cols, ["sequence", "slot", "shard", "n_tokens", "doc_ids", "ids"])

    def write(batches):
        import pyarrow as pa

        schema = pa.schema([("sequence", pa.int64()), ("slot", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
        rows = (r for b in batches for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist())
        fill = np.array([END], "<u2").tobytes() * length

        def told(first):
            """Writes the shard; a row of each sequence once it is written, so that no more than a batch is held."""
            with store.part_file(f"{folder}/{_name(first['shard'])}") as out:
                for r in _chain(first, rows):
                    out.write((r["ids"] + fill)[:stride])
                    yield r["sequence"], r["slot"], r["shard"], (r["slot"] % shard_sequences) * stride, r["n_tokens"], zlib.crc32(r["ids"]), r["doc_ids"]

        if (first := next(rows, None)) is not None:
            yield from as_batches(told(first), schema, 64)

    kind = "sequence long, slot long, shard int, n_tokens long, doc_ids array<long>, ids binary"
    few = parts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    placed = cut.join(F.broadcast(base) if few else base, "part").select("base", "i", "n_tokens", "doc_ids", "ids").mapInArrow(place, kind)
    ranged = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    out = written(ranged.mapInArrow(write, "sequence long, slot long, shard int, offset long, n_tokens long, ids_crc32 long, doc_ids array<long>"), "slots")
    drop_path(spark, made)
    manifest = {"sequences": total, "length": length, "width": WIDTH, "shard_sequences": shard_sequences, "shards": shards if total else 0, "key": key, "fill": END}
    store.write_then_move(f"{folder}/manifest.json", [json.dumps(manifest).encode()])
    return out


def _chain(first, rest):
    yield first
    yield from rest


def _name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def read_from(folder: str, slot: int = 0):
    """(slot, ids) in training order from any slot on: one seek, then sequential reads."""
    fs, path = store.resolve(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        m = json.loads(f.read())
    stride = m["length"] * m["width"]
    while slot < m["sequences"]:
        with fs.open_input_file(f"{path}/{_name(slot // m['shard_sequences'])}") as f:
            f.seek(slot % m["shard_sequences"] * stride)
            while len(raw := f.read(stride)) == stride:
                yield slot, np.frombuffer(raw, "<u2")
                slot += 1
