"""Cost-balanced packing of token sequences.

A sequence's cost is estimated as a * tokens + b * tokens ** 2 summed over its pieces (attention does not cross
pieces). Documents go, longest first, to the lowest-cost sequence with remaining room; what fits in no sequence
whole is cut, at the room of the emptiest one. The documents of a partition are packed in groups of a bounded number of tokens, in reading order,
so nothing is shuffled and a lost task is repeated with the same outcome.

A group's sequences hold exactly its tokens: 2048 each, and for the rest a few whose lengths are powers of two.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from quillmatch.llm.tokens import as_batches, texts_of, worker_tokenizer

#: Of a piece of n tokens: LINEAR * n + QUADRATIC * n ** 2, in units of one token's linear work.
LINEAR, QUADRATIC = 1.0, 1.0 / 6144

#: Tokens of a group, at which it is packed.
GROUP = 1 << 20


def capacities(tokens: int, length: int) -> list[int]:
    """Full sequences, then the binary digits of what is left."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pack(lengths: list[int], length: int = 2048, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, piece length, sequence, offset) of each piece, for documents of these lengths.

    Every token lies in exactly one piece; sequences are numbered from 0 and gapless. Ties: the earlier document, the
    earlier sequence. A document longer than a sequence first fills sequences of its own.
    """
    room = capacities(sum(lengths), length)
    whole = [(d, s) for d, n in enumerate(lengths) for s in range(0, n - n % length, length)]
    out = [(d, s, length, i, 0) for i, (d, s) in enumerate(whole)]
    first = len(whole)
    left = np.array(room[first:], np.int64)
    size, cost = left.copy(), np.zeros(len(left))
    rests = sorted(((n % length, d, n - n % length) for d, n in enumerate(lengths) if n % length), key=lambda x: (-x[0], x[1]))
    for n, d, start in rests:
        while n:
            fits = np.where(left >= n, cost, np.inf)
            i = int(fits.argmin())
            take = n
            if fits[i] == np.inf:
                i = int(left.argmax())  # fewest pieces
                take = int(left[i])
            out.append((d, start, take, first + i, int(size[i] - left[i])))
            left[i] -= take
            cost[i] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return out


def pack_documents(documents: DataFrame, length: int = 2048, end_id: int = 1, path: str | None = None, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    ids: array<int>. A document's tokens are its text's and end_id. Null or empty text: end_id alone, still a piece.
    Null doc_id: kept as null. Repeated rows are packed each. Empty table: no rows. Only doc_id and text are read.
    sequence_id: the partition's number times 2 ** 32, and a number counted within it.
    """
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        schema = pa.schema([(x, pa.int64()) for x in names] + [("ids", pa.list_(pa.int32()))] * with_ids)
        yield from as_batches(rows(batches, TaskContext.get().partitionId() << 32), schema)

    def rows(batches, sequence):
        tokenizer, end = worker_tokenizer(path), np.array([end_id], np.uint32)

        def flush():
            for d, start, n, s, offset in pack([len(x) for _, x in held], length):
                doc_id, ids = held[d]
                piece = ids[start : start + n]
                yield (doc_id, start, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence + s, offset, *([piece.astype(np.int32)] * with_ids))

        held, tokens = [], 0
        for doc_id, text in texts_of(batches):
            held.append((doc_id, np.concatenate([tokenizer.ids(text), end])))
            tokens += len(held[-1][1])
            if tokens >= group:
                yield from flush()
                sequence += len(capacities(tokens, length))
                held, tokens = [], 0
        yield from flush()

    return documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")).mapInArrow(run, kind)
