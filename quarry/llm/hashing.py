"""64-bit digests of words, lines and word shingles, for whole Arrow batches at a time with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed only."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 7)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: Space and the five ASCII line and tab controls.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Spans:
    """Digests of any byte ranges of a piece of text: a running polynomial, read at both ends of a range."""

    def __init__(self, data: np.ndarray, lower: bool = False) -> None:
        power, self._inverse = _power_tables(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """The words of some documents, one after another: byte ranges, digests, and where each document begins."""

    start: np.ndarray
    end: np.ndarray
    digest: np.ndarray
    first: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents whose bytes lie between successive offsets of data; offsets begin with 0."""
    word = ~_SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = word[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = word[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
    end = np.flatnonzero(word & ~after) + 1
    return Words(start, end, Spans(data, lower).of(start, end), np.searchsorted(start, offsets))


def grams(digest: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Digest of the n words from each place on, also across documents; the last n - 1 places are left out."""
    if len(digest) < n:
        return np.empty(0, np.uint64)
    weight = constants(n, seed)
    total = digest[: len(digest) - n + 1] * weight[0]
    for k in range(1, n):
        total = total + digest[k : len(digest) - n + 1 + k] * weight[k]
    return mix(total + np.uint64(n))


def shingle_lists(words: Words, n: int) -> list[np.ndarray]:
    """The n-word shingles of each document in order; the whole sequence as one if it is shorter, none without words."""
    found = grams(words.digest, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        out.append(found[a : b - n + 1] if b - a >= n else grams(words.digest[a:b], b - a) if b > a else found[:0])
    return out


_STEP = [int(c) for c in constants(2, 23)]
_run_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _run_powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _run_tables or len(_run_tables[which][0]) < n:
        both = []
        for base in (_STEP[which], pow(_STEP[which], -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _run_tables[which] = both[0], both[1]
    return _run_tables[which]


def run_digests(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of the word sequences from first to before last."""
    out = []
    for which in range(2):
        power, inverse = _run_powers(which, len(words) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)))
        out.append(mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)))
    return out
