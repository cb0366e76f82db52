"""Words and word sequences of many texts at once, as arrays of hashes."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np

#: A word is a maximal run of letters and digits of any script in the lower-cased text.
WORD = re.compile(r"[^\W_]+")
#: Odd multipliers and shifts of the public splitmix64 finaliser.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An odd number, of whose powers hashes of sequences are made, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters that are looked at together; a longer text is looked at by itself.
CHARACTERS_AT_ONCE = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every character, whether it belongs to words (as `WORD` has it), and a random number."""
    n = 0x110000
    return np.fromiter((chr(i).isalnum() for i in range(n)), bool, n), mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHARACTERS_AT_ONCE)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of `values` from `start` to `end`, which doesn't depend on where the run stands."""
    up, down = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > CHARACTERS_AT_ONCE:
            yield start, i
            start, held = i, 0
        held += n + 1
    yield start, len(lengths)


def hash_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the offsets at which each text starts (one more than texts); a null text has none."""
    lower = [t.lower() if t else "" for t in texts]
    is_word, number = _characters()
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _chunks([len(t) for t in lower]):
        codes = np.frombuffer("\n".join(lower[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = is_word[codes]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes.append(run_hashes(number[codes], start, end))
        ends = np.cumsum([len(t) + 1 for t in lower[a:b]])
        counts.append(np.diff(np.searchsorted(start, ends), prepend=0))
    return np.concatenate(hashes), np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64)


class WordHashes(dict):
    """Word to its hash, computed once for each word; emptied beyond `limit` words so that memory stays bounded."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = int(hash_words([word])[0][0])
        return h


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashed(texts: Sequence[list[str]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """As `hash_words`, for texts that are lists of words already."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    flat = np.fromiter((cache[w] for t in texts for w in t), np.uint64, int(offsets[-1]))
    return flat, offsets


def sequences(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and starting word of every `n` consecutive words; sequences never cross texts."""
    m = max(0, len(flat) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = mix(h + flat[k : k + m] + np.uint64(0x9E3779B97F4A7C15))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    at = np.arange(m)
    inside = at + n <= offsets[1:][text] if m else np.zeros(0, bool)
    return h[inside], text[inside], (at - offsets[:-1][text])[inside] if m else at
