"""Words of whole texts and hashes of word windows, vectorized over a batch of texts.

Words are the maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D) of a text's UTF-8 form. A word's code
has two 64-bit halves: sums of random codes of its bytes times powers, with independent codes and multipliers; words of more
than 64 bytes, where such sums can be made to agree, have their xxh3 hash. A window's hash are two such sums of its words'
codes; windows are equal where both halves are. For windows of at most 64 words, each half of two different ones agrees by a
chance below 2^-49, so n windows hold two different ones that agree with a chance below n^2 / 2^98. Longer windows are
hashed piece by piece, and the pieces' hashes likewise.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: Odd multipliers of the running sums, one for each half: of bytes and of words.
BYTE_BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
WORD_BASES = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
#: Longest word, and longest window, that one sum stands for.
LONGEST = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = [mix(np.arange(1, 257, dtype=U64) * k) for k in (U64(0x2545F4914F6CDD1D), U64(0xDA942042E4DD58B5))]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _table(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    key = (int(base), inverse)
    if key not in _powers or len(_powers[key]) < n:
        b = U64(pow(int(base), -1, 1 << 64)) if inverse else base
        _powers[key] = powers(b, max(n, 1 << 16) * 5 // 4)
    return _powers[key][:n]


def running(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0: runs can be hashed by a subtraction."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _table(base, len(values)), out=out[1:])
    return out


def run_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * _table(base, len(prefix), True)[starts])


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words as (2, words), first word of each text with the total at the end)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        joined = LOWER[joined]
    inside = np.zeros(len(joined) + 2, np.int8)
    inside[1:-1] = ~SPACE[joined]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sizes = (ends - starts).astype(U64)
    codes = np.stack([run_hash(running(table[joined], base), starts, ends, base) + sizes for table, base in zip(BYTE_CODES, BYTE_BASES, strict=True)])
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        codes[:, i] = np.frombuffer(xxhash.xxh3_128_digest(joined[starts[i] : ends[i]].tobytes()), U64)
    limits = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=limits[1:])
    return codes, np.searchsorted(starts, limits)


class Windows:
    """Hashes of windows of consecutive words of one text each."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        self.n, self.first = codes.shape[1], first
        self.prefix = [running(mix(codes[k]), base) for k, base in enumerate(WORD_BASES)]
        #: For each word, the end of its text.
        self.end = np.repeat(first[1:], np.diff(first))

    def starts(self, length: int) -> np.ndarray:
        """All words at which a window of that length begins."""
        return np.flatnonzero(np.arange(self.n) + length <= self.end)

    def hash(self, starts: np.ndarray, length: int | np.ndarray, half: int = 0) -> np.ndarray:
        base = WORD_BASES[half]
        if np.max(length, initial=0) <= LONGEST:
            return run_hash(self.prefix[half], starts, starts + length, base)
        out = np.zeros(len(starts), U64)
        at, end = starts.copy(), starts + length
        while (left := np.minimum(LONGEST, end - at)).any():
            out = mix(out * base + run_hash(self.prefix[half], at, at + left, base)) * (left > 0) + out * (left == 0)
            at = at + left
        return out


def equal_runs(high: np.ndarray, low: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): an order in which equal pairs (within equal values of ``before``) stand together, and where in it each run begins."""
    order = np.lexsort((high, *before)) if before else np.argsort(high)
    same = np.all([x[order][1:] == x[order][:-1] for x in (high, *before)], axis=0)
    fresh = np.ones(len(order), bool)
    fresh[1:] = ~same
    if (same & (low[order][1:] != low[order][:-1])).any():  # the first halves agree by chance
        order = np.lexsort((low, high, *before))
        fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in (low, high, *before)], axis=0)
    return order, fresh


def chunks(sizes: list[int], most: int = 1 << 20):
    """Slices of a batch whose sizes add up to about ``most``, so that arrays stay small whatever the batch holds."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
