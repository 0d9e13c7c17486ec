"""Best-fit packing of documents under several capacities at once.

A sequence has room for so many tokens, so many documents and so much attention cost (the sum of its documents'
squared lengths, as attention does not cross documents). Documents go, largest first, to a sequence that has room for
them in every respect: the one whose weighted residual norm is least afterwards, or whose residual has the greatest
weighted dot product with the document. Only what fits in none opens another one.

A partition's documents are packed in groups of a bounded number of tokens, in reading order, so nothing is shuffled
and a lost task is repeated with the same outcome. Sequences that a group leaves with room go, up to a bound, back
into the next group.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quillmatch.llm.bytebpe import worker_chunks
from quillmatch.llm.tokens import as_batches, texts_of

#: Tokens of a group, and of what goes back into the next one.
GROUP, CARRIED = 1 << 21, 1 << 19

#: Free tokens of a sequence, as a share of its length (1 / SLACK), with which it counts as full.
SLACK = 512


@dataclass(frozen=True)
class Room:
    """What one sequence holds. cost None: as much as one document of `tokens` takes.

    weights: of tokens, documents and cost in the choice of a sequence, each as a share of its capacity.
    """

    tokens: int = 2048
    documents: int = 1024
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.tokens**2 if self.cost is None else self.cost], np.int64)

    def longest(self) -> int:
        """Tokens of the longest piece that an empty sequence takes."""
        tokens, documents, cost = (int(x) for x in self.capacity())
        n = min(tokens, int(np.sqrt(float(cost))) + 1)
        while n * n > cost:
            n -= 1
        if n < 1 or documents < 1:
            raise ValueError("a sequence must have room for a token")
        return n


def best_fit(lengths: list[int], room: Room = Room()) -> list[int]:
    """The sequence of each piece, numbered from 0 as they are opened. Ties: the earlier piece, the earlier sequence."""
    capacity, weights = room.capacity(), np.array(room.weights)
    scale = weights / capacity.astype(float) ** 2
    of, free, opened = [0] * len(lengths), np.zeros((max(16, len(lengths)), 3), np.int64), 0
    live = np.zeros(0, np.int64)  # sequences that still have room for the smallest piece left
    least = min(lengths, default=1)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = np.array([lengths[i], 1, lengths[i] ** 2], np.int64)
        rest = free[live] - need
        fits = np.flatnonzero((rest >= 0).all(axis=1))
        if not len(fits):
            chosen = opened
            free[opened] = capacity
            live = np.append(live, opened)
            opened += 1
        elif room.rule == "norm":
            chosen = live[fits[((rest[fits].astype(float) ** 2) @ scale).argmin()]]
        else:
            chosen = live[fits[((free[live[fits]] * need.astype(float)) @ scale).argmax()]]
        free[chosen] -= need
        if (free[chosen] < (least, 1, least**2)).any():
            live = live[live != chosen]
        of[i] = int(chosen)
    return of


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of the longest length, but the first may be shorter."""
    first = n % longest or longest
    return [(0, min(first, n))] + [(s, longest) for s in range(first, n, longest)]


def pack_documents(documents: DataFrame, room: Room = Room(), end_id: int = 0, path: str | None = None, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    ids: array<int>. A document's tokens are its text's and end_id; only those longer than an empty sequence has room
    for are cut. Null or empty text: end_id alone, still a piece. Null doc_id: kept as null. Repeated rows are packed
    each. Empty table: no rows. Only doc_id and text are read. sequence_id: the partition's number times 2 ** 32, and
    a number counted within it.
    """
    longest = room.longest()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = ", ".join(f"{x} {'int' if x == 'piece' else 'long'}" for x in names) + ", ids array<int>" * with_ids

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([(x, pa.int32() if x == "piece" else pa.int64()) for x in names] + [("ids", pa.list_(pa.int32()))] * with_ids)
        yield from as_batches(rows(batches, TaskContext.get().partitionId() << 32), schema)

    def rows(batches, sequence):
        tokenizer, end = worker_chunks(path), np.array([end_id], np.uint32)
        held, tokens = [], 0

        def told(piece, number, offset):
            doc_id, k, start, n, crc, ids = piece
            return (doc_id, k, start, n, crc, number, offset, *([ids] * with_ids))

        def flush(last):
            """Rows of the sequences that are done; what has room goes back into held."""
            nonlocal held, tokens, sequence
            of = best_fit([p[3] for p in held], room)
            members: dict[int, list] = {}
            for p, s in zip(held, of, strict=True):
                members.setdefault(s, []).append(p)
            rooms = {s: room.tokens - sum(p[3] for p in ps) for s, ps in members.items()}
            back, held, tokens = set(), [], 0
            if not last:
                for s in sorted(members, key=lambda s: (-rooms[s], s)):
                    used = room.tokens - rooms[s]
                    if rooms[s] * SLACK <= room.tokens or tokens + used > min(CARRIED, group // 4):
                        break
                    back.add(s)
                    tokens += used
            for s, ps in members.items():
                if s in back:
                    held += ps
                    continue
                offset = 0
                for p in ps:
                    yield told(p, sequence, offset)
                    offset += p[3]
                sequence += 1

        for doc_id, text in texts_of(batches):
            ids = np.concatenate([tokenizer.ids(text), end])
            for k, (start, n) in enumerate(cut(len(ids), longest)):
                own = ids[start : start + n]
                piece = (doc_id, k, start, n, zlib.crc32(own.astype("<u4").tobytes()), own.astype(np.int32) if with_ids else None)
                if n == room.tokens:
                    yield told(piece, sequence, 0)
                    sequence += 1
                else:
                    held.append(piece)
                    tokens += n
            if tokens >= group:
                yield from flush(False)
        yield from flush(True)

    return documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")).mapInArrow(run, kind)
