"""Word spans and rolling word hashes of many texts at once, on the UTF-8 bytes of an Arrow string column.

Words are runs of anything but U+0020 and U+0009 to U+000D. Those separators are single bytes that occur in
no longer UTF-8 sequence, so splitting bytes splits characters.
"""

from __future__ import annotations

from functools import cache

import numpy as np

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _constants(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE = _constants(101, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: Multipliers of the byte hash and of the two word-sequence hashes; each is 5 modulo 8, so of longest period.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A4D, 0xD1342543DE82EF95
#: Powers kept for each base: 4 MB, enough for a slice of texts (``common.SLICE_BYTES``).
KEPT_BITS = 19


def _powers(base: int, bits: int) -> np.ndarray:
    """base**i mod 2**64 for i below 2**bits, by repeated doubling."""
    out = np.ones(1 << bits, U64)
    step = base
    for k in range(bits):
        out[1 << k : 2 << k] = out[: 1 << k] * U64(step)
        step = step * step % (1 << 64)
    return out


@cache
def _kept_powers(base: int) -> np.ndarray:
    return _powers(base, KEPT_BITS)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**n. A worker keeps one table a base, of 2**KEPT_BITS values; longer ones last for a call."""
    return (_kept_powers(base) if n < 1 << KEPT_BITS else _powers(base, int(n).bit_length()))[: n + 1]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per row the number of the first word (one more than rows)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = _IS_WORD[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash per word; ``lower`` folds A-Z first."""
    if not len(starts):
        return np.empty(0, U64)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    weighted = (_BYTE_LOWER if lower else _BYTE)[data]
    weighted *= powers(BYTE_BASE, len(data))[: len(data)]
    np.cumsum(weighted, out=total[1:])
    value = total[ends]
    value -= total[starts]
    value *= powers(inverse(BYTE_BASE), len(data))[starts]
    return mix(value)


class Rolling:
    """Hashes of any word runs of a slice in constant time each, from prefix sums."""

    def __init__(self, words: np.ndarray, base: int = WORD_BASE):
        self.total = np.zeros(len(words) + 1, U64)
        np.cumsum(words * powers(base, len(words))[: len(words)], out=self.total[1:])
        self.back = powers(inverse(base), len(words))

    def run(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        out = self.total[start + length] - self.total[start]
        out *= self.back[start]
        return out


def windows(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``length`` words inside one row, and the row of each. first: see word_spans."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][rows], rows
