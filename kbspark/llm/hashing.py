"""64-bit hashes of many byte strings at once, with NumPy; all arithmetic wraps around."""

from __future__ import annotations

import numpy as np

_RATIO = np.uint64(0x9E3779B97F4A7C55)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
#: A prime, and a ratio modulo it. Powers of the first ratio alone, modulo a power of two, give the same
#: sums for certain pairs of long strings of two letters (a Thue-Morse word and its complement).
_PRIME, _SECOND = np.uint64((1 << 31) - 1), 1_220_703_125
_second = np.ones(1, np.uint64)
_second_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of the 64-bit numbers that leaves no pattern."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One number for each byte.
LETTERS = mix(np.arange(1, 257, dtype=np.uint64), 11)


def _powers_of(ratio: int, size: int) -> np.ndarray:
    """The powers of a ratio modulo the prime."""
    out, n = np.ones(size, np.uint64), 1
    while n < size:
        more = min(n, size - n)
        out[n : n + more] = out[:more] * np.uint64(pow(ratio, n, int(_PRIME))) % _PRIME
        n += more
    return out


def _grown(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The powers of both ratios and of their inverses, at least n of each."""
    global _powers, _inverse, _second, _second_inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_RATIO), -1, 1 << 64))
        _powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _RATIO)])
        _inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, inverse)])
        _second = _powers_of(_SECOND, size)
        _second_inverse = _powers_of(pow(_SECOND, -1, int(_PRIME)), size)
    return _powers[:n], _inverse[:n], _second[:n], _second_inverse[:n]


class Prefixes:
    """Hashes of any substrings of one byte array: equal substrings have equal hashes.

    A hash joins two polynomials: one modulo 2^64, and one modulo a prime, which no pattern in the bytes
    makes vanish along with the first. With rough, where different substrings may share a hash, the first will do.
    """

    def __init__(self, data: np.ndarray, letters: np.ndarray = LETTERS, rough: bool = False):
        self.rough = rough
        powers, self.inverse, second, self.second_inverse = _grown(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = letters[data]
        np.cumsum(values * powers[:-1], out=self.sums[1:])
        if rough:
            return
        self.second = np.zeros(len(data) + 1, np.uint64)
        # terms below 2^62 brought below 2^32, so sums of 2^32 of them fit
        values >>= np.uint64(33)
        values *= second[:-1]
        np.cumsum((values & _PRIME) + (values >> np.uint64(31)), out=self.second[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return self._between(start, start + length)

    def every(self, length: int) -> np.ndarray:
        """of() for all starts in order, without looking them up one by one."""
        n = len(self.sums) - length
        return self._between(slice(0, n), slice(length, n + length))

    def _between(self, start, end) -> np.ndarray:
        first = (self.sums[end] - self.sums[start]) * self.inverse[start]
        if self.rough:
            return first
        second = (self.second[end] - self.second[start]) % _PRIME * self.second_inverse[start] % _PRIME
        return first + mix(second, 7)


#: Bytes over which sums are held at once for the hashes of words.
PIECE_BYTES = 1 << 19
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
#: A to Z count as a to z.
LOWER_LETTERS = LETTERS.copy()
LOWER_LETTERS[65:91] = LETTERS[97:123]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased; and where each text's words begin (one more entry than texts)."""
    data = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~SEPARATOR[data]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # PIECE_BYTES of words at a time, or one longer word
        last = max(first + 1, int(np.searchsorted(starts + lengths, starts[first] + PIECE_BYTES, "right")))
        begin, end = starts[first], starts[last - 1] + lengths[last - 1]
        hashes[first:last] = Prefixes(data[begin:end], LOWER_LETTERS).of(starts[first:last] - begin, lengths[first:last])
        first = last
    return mix(mix(hashes, 3) + lengths.astype(np.uint64), 4), np.r_[0, np.searchsorted(starts, ends)]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of k words; of fewer words, the one of all of them."""
    words, bounds = word_hashes(texts)
    joined = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        joined = joined * _RATIO + words[i : i + len(joined)]
    joined = mix(joined, 5)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            sets.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for w in words[a:b]:
                short = short * _RATIO + w
            sets.append(mix(short, 6 + int(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
