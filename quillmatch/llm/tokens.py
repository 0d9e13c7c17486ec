"""Token ids on the executors: one tokenizer a worker, with a bounded cache of what it says of each chunk of text.

The vocabulary file's own rules drop white space and cut at it, so a text's ids are those of its chunks in order.
A chunk of Latin letters, or of them and ASCII punctuation, is just these two pieces to the vocabulary's rules, the
letters in lower case; they go to its merges directly. Any other chunk takes the whole way.

Most texts are Latin-1 with full stops and commas that touch no other mark. In these, lower case and a space on both
sides of such a mark change no id, and bytes can be cut into words that repeat far more often.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array

import numpy as np

_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Of byte-level vocabularies: the letter that stands for each byte; printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


def default_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _of_latin(rule) -> bytes:
    return bytes(rule(chr(i)) for i in range(256))


#: Latin-1 bytes in lower case; and by kind: a full stop or comma, any other mark, all else.
_LOWER = _of_latin(lambda c: ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c))
_KIND = _of_latin(lambda c: ord(".") if c in ".," else ord("a") if c.isalnum() or c in " \t\n\r\v\f\x85\xa0" else ord("!"))


class _Words(dict):
    """Latin-1 word in lower case, or a mark -> its ids as bytes."""

    def __init__(self, owner: ChunkTokenizer):
        super().__init__()
        self._owner = owner

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self._owner._limit:
            self.clear()
        text = word.decode("latin-1")
        if word in (b".", b",") or (m := _LATIN.fullmatch(text)) and not m[2]:
            found = self._owner._piece(text)
        else:
            found = self._owner._encode(text)
        if len(word) <= 64:
            self[word] = found
        return found


class ChunkTokenizer(dict):
    """chunk -> its ids as bytes, four to an id. Emptied when it holds `limit` chunks; that changes no id."""

    def __init__(self, path: str | None = None, specials_as_text: bool = False, limit: int = 150_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path or default_path())
        self._t.encode_special_tokens = specials_as_text
        self._merge, self._letters = self._t.model.tokenize, _byte_letters()
        self._latin = _Words(self)
        self._limit, self._words = limit, {}

    def _encode(self, chunk: str) -> bytes:
        return array("I", self._t.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._merge(piece)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self._limit:
            self.clear()
        if len(self._words) >= self._limit:
            self._words.clear()
        if m := _LATIN.fullmatch(chunk):
            word, marks = m.groups()
            word = word.lower()
            if (found := self._words.get(word)) is None:
                found = self._words[word] = self._piece(word)
            if marks:
                if (more := self._words.get(marks)) is None:
                    more = self._words[marks] = self._piece(marks)
                found += more
        else:
            found = self._encode(chunk) if chunk else b""
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of a text; none for null."""
        if not text:
            return np.zeros(0, np.uint32)
        if (words := _latin_words(text)) is not None:
            found = map(self._latin.__getitem__, words)
        else:
            found = map(self.__getitem__, text.replace("\n", " ").split(" "))
        return np.frombuffer(b"".join(found), np.uint32)


def _latin_words(text: str) -> list[bytes] | None:
    """Lower-case words and marks of a text that may be cut so; None of any other."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    kinds = raw.translate(_KIND)
    if b".." in kinds or b"!." in kinds or b".!" in kinds or b"<|" in raw:
        return None
    return raw.translate(_LOWER).replace(b".", b" . ").replace(b",", b" , ").split()


_WORKER: dict[tuple, ChunkTokenizer] = {}


def worker_tokenizer(path: str | None = None, specials_as_text: bool = False) -> ChunkTokenizer:
    """This worker's tokenizer. path None: the public file where this worker runs."""
    if (key := (path, specials_as_text)) not in _WORKER:
        _WORKER[key] = ChunkTokenizer(path, specials_as_text)
    return _WORKER[key]


def texts_of(batches, rows: int = 256):
    """(doc_id, text) of Arrow batches with columns doc_id and text, a few rows in Python at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def as_batches(rows, schema, size: int = 4096):
    """Arrow batches of tuples."""
    import pyarrow as pa

    it = iter(rows)
    while part := list(itertools.islice(it, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)
