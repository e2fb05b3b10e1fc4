"""64-bit hashes of byte ranges, words and word shingles on flat numpy buffers."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Space and the control characters tab to carriage return part words.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Kept(dict):
    """Values a process works out once; empty when it travels."""

    def __reduce__(self):
        return Kept, ()


#: A random number per byte; the second table reads A-Z as a-z.
BYTE_VALUES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), U)
FOLDED_VALUES = np.r_[BYTE_VALUES[:65], BYTE_VALUES[97:123], BYTE_VALUES[91:]]
_KEPT = Kept()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_KEPT.get("powers", ((), ()))[0]) < n:
        size, kept = 1 << max(16, (n - 1).bit_length()), []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, U)
            steps[0] = 1
            kept.append(np.multiply.accumulate(steps))
        _KEPT["powers"] = kept
    return _KEPT["powers"]


class Ranges:
    """Hashes of any byte ranges of a buffer, each in constant time (polynomial prefix sums)."""

    def __init__(self, raw: np.ndarray, fold_case: bool = False):
        powers, self.inverse = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum((FOLDED_VALUES if fold_case else BYTE_VALUES)[raw] * powers[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))

    def grams(self, q: int) -> np.ndarray:
        """Of each run of q bytes, by its start."""
        n = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:n]) * self.inverse[:n] + U(q)) if n > 0 else np.zeros(0, U)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACES[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = solid & (~before | edge[:-1])
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = solid & (~after | edge[1:])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int, fold_case: bool = True) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles of ``width`` words.

    A row with fewer words has its whole sequence as the only one; a row without words has none.
    """
    starts, ends, first = word_spans(raw, offsets)
    if not len(starts):
        return [np.zeros(0, U)] * (len(offsets) - 1)
    words = Ranges(raw, fold_case).of(starts, ends)
    powers = [U(pow(BASE, 2 * i + 3, 1 << 64)) for i in range(width)]
    whole = np.zeros(max(0, len(words) - width + 1), U)
    for i, p in enumerate(powers):
        whole += words[i:len(words) - width + 1 + i] * p
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(whole[a:b - width + 1])
            if len(s) > 1:
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                s = s[new]
            out.append(s)
        elif b > a:
            acc = U(b - a)
            for i in range(b - a):
                acc = np.add(acc, np.multiply(words[a + i:a + i + 1], powers[i]))
            out.append(mix(acc))
        else:
            out.append(np.zeros(0, U))
    return out
