"""Ids of byte-level vocabularies on the executors, with a bounded cache of chunks.

Such a vocabulary's rules cut a text into words with the one space before them, numbers, marks, and white space; the
merges see one such piece at a time. A text may therefore be cut at any boundary of pieces. In most Latin-1 texts a
space, a line break, and a full stop or comma after a letter or digit each begin a piece, which byte operations find.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from quillmatch.llm.tokens import default_path

#: The pieces of byte-level vocabularies, for Latin-1 text.
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_PIECE = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")


def _kind(c: str) -> str:
    if c in " \n":
        return c
    if c.isspace():
        return "\t"
    return "." if c in ".," else "a" if re.match(f"[{_LETTERS}{_DIGITS}]", c) else "!"


_KIND = bytes(ord(_kind(chr(i))) for i in range(256))

#: Where a stop, comma, space or line break does not begin a piece, or white space is no single space or line break.
_UNSURE = re.compile(rb"[.!\s]\.|\s\s|\t")


class ByteChunks(dict):
    """chunk of Latin-1 text -> its ids as bytes, four to an id. When it holds `limit` chunks these become the older half; no id changes."""

    def __init__(self, path: str | None = None, limit: int = 250_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = path or default_path("byte_bpe_50k.json")
        self._t = Tokenizer.from_file(path)
        self._special = [t.content for t in self._t.get_added_tokens_decoder().values()]
        self._merge = _merger(path)
        self._limit, self._older = limit, {}

    def _encode(self, text: str) -> bytes:
        return array("I", self._t.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if (found := self._older.get(chunk)) is None:
            if self._merge is None:
                found = self._encode(chunk)
            elif (chunk[1:] if chunk[:1] == " " else chunk).isalpha():
                found = array("I", self._merge(chunk.encode())).tobytes()
            else:
                found = array("I", [i for piece in _PIECE.findall(chunk) for i in self._merge(piece.encode())]).tobytes()
        if len(chunk) <= 64:
            if len(self) >= self._limit:
                self._older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of a text; none for null."""
        if not text:
            return np.zeros(0, np.uint32)
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)) if (chunks := self._chunks(text)) else self._encode(text), np.uint32)

    def _chunks(self, text: str) -> list[str] | None:
        """The text in parts whose ids are the text's; None: it has to be taken whole."""
        if any(s in text for s in self._special):
            return None
        try:
            kinds = text.encode("latin-1").translate(_KIND)
        except UnicodeEncodeError:
            return None
        if re.search("[\x1c-\x1f]", text):  # white space to Python only, and the mark used below
            return None
        if _UNSURE.search(kinds):
            return _PIECE.findall(text)
        return text.replace(" ", "\x1f ").replace(".", "\x1f.").replace(",", "\x1f,").replace("\n", "\x1f\n\x1f").split("\x1f")


def _merger(path: str):
    """bytes of a piece -> ids, if the vocabulary is one whose ids are in the order of its merges; else None."""
    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    if len(vocab) != 256 + len(model["merges"]) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


_WORKER: dict[str | None, ByteChunks] = {}


def worker_chunks(path: str | None = None) -> ByteChunks:
    """This worker's tokenizer. path None: the public file where this worker runs."""
    if path not in _WORKER:
        _WORKER[path] = ByteChunks(path)
    return _WORKER[path]
