"""64-bit hashes of the words of many texts at once, with array arithmetic on their bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(7)
#: A random odd factor for each byte value, and the base of the polynomial in a byte's place.
_OF_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes by kind: 0 separates, all others belong to a word with neighbours of the same kind.
SPACES = np.ones(256, np.uint8)
SPACES[[32, 9, 10, 11, 12, 13]] = 0
#: Letters, digits and all that is not ASCII are 1, other printable characters 2.
TEXT = np.full(256, 2, np.uint8)
TEXT[[*range(33), 127]] = 0
TEXT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. n - 1, modulo 2 ** 64."""
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z as a-z, and how many words each text has."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = kinds[raw]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([np.zeros(1, np.int64), edge])
    lens = np.diff(starts, append=len(raw))
    place = np.arange(len(raw)) - np.repeat(starts, lens)
    part = _OF_BYTE[_LOWER[raw]]
    part *= powers(int(lens.max()))[place]
    full = np.add.reduceat(part, starts)
    real = kind[starts] > 0
    hashes = mix(full[real] + lens[real].astype(np.uint64))
    of = np.searchsorted(np.cumsum(sizes), starts[real], side="right")
    return hashes, np.bincount(of, minlength=len(texts))


def parts(rows, limit: int = 1 << 20):
    """Lists of (key, text bytes), each of at most `limit` bytes or of one text."""
    held, n = [], 0
    for key, text in rows:
        raw = (text or "").encode()
        if held and n + len(raw) > limit:
            yield held
            held, n = [], 0
        held.append((key, raw))
        n += len(raw)
    if held:
        yield held
