"""Words of texts as NumPy arrays over Arrow's buffers, without an object for each word.

A word is a longest run of bytes other than ``[\\x20\\x09-\\x0D]``. Word hashes
are differences of prefix sums of a polynomial over the bytes; they are equal
for equal words, and operators verify where different words must not pass as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed value: what separates words.
WHITE = b"\t\n\x0b\x0c\r "
IS_WORD = ~np.isin(np.arange(256), list(WHITE))

#: So many bytes are looked at in one go; a word longer than that is taken whole.
BLOCK = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all (the finaliser of splitmix64)."""
    x = x + np.uint64(_FACTOR)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, for either of two independent hashes.
_VALUES = mix(np.arange(512, dtype="u8")).reshape(2, 256)
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the factor and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, f in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(n, f, "u8")
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins, with the end of the last; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = "i8" if pa.types.is_large_string(column.type) else "i4"
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype("i8") if offsets else np.zeros(1, "i8")
    return np.frombuffer(data, "u1") if data else np.empty(0, "u1"), at


def portions(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many bytes; a longer text is a range of its own."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def _ends(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that cut no word."""
    low, n = 0, len(data)
    while low < n:
        high = min(low + BLOCK, n)
        if high < n:
            white = np.flatnonzero(~IS_WORD[data[low:high]])
            if len(white):
                high = low + int(white[-1]) + 1
            else:  # a word as long as the range: up to its end
                while high < n and IS_WORD[data[high]]:
                    step = data[high : high + BLOCK]
                    stop = np.flatnonzero(~IS_WORD[step])
                    high += int(stop[0]) if len(stop) else len(step)
                following = bounds[np.searchsorted(bounds, low, "right")]
                high = min(high, int(following))
        yield low, high
        low = high


def words(data: np.ndarray, bounds: np.ndarray, lanes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, end, first, hashes) of the words of texts that lie between ``bounds``: text i has words first[i] to first[i + 1]."""
    starts, ends, hashes = [], [], [[] for _ in range(lanes)]
    inner = bounds[1:-1]
    for low, high in _ends(data, bounds):
        part = data[low:high]
        own = IS_WORD[part]
        cuts = inner[np.searchsorted(inner, low, "right") : np.searchsorted(inner, high, "left")] - low
        new = own.copy()
        new[1:] &= ~own[:-1]
        new[cuts] = own[cuts]
        last = own.copy()
        last[:-1] &= ~own[1:]
        last[cuts - 1] = own[cuts - 1]
        start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
        power, inverse = powers(len(part))
        for lane in range(lanes):
            sums = np.zeros(len(part) + 1, "u8")
            np.cumsum(_VALUES[lane][part] * power, out=sums[1:])
            hashes[lane].append(mix((sums[end] - sums[start]) * inverse[start]))
        starts.append(start + low)
        ends.append(end + low)
    start = np.concatenate(starts) if starts else np.empty(0, "i8")
    end = np.concatenate(ends) if ends else np.empty(0, "i8")
    return start, end, np.searchsorted(start, bounds), [np.concatenate(h) if h else np.empty(0, "u8") for h in hashes]


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, by doubling; empty if there are fewer words."""
    if len(hashes) < n:
        return np.empty(0, "u8")
    join = lambda a, b, gap: mix(a[: len(b) - gap] * np.uint64(_INVERSE) + b[gap:])
    out, size, power, width = None, 0, hashes, 1
    while True:
        if n & width:
            out = power if out is None else join(out, power, size)
            size += width
        if size == n:
            return out[: len(hashes) - n + 1]
        power = join(power, power, width)
        width *= 2


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = BLOCK) -> np.ndarray:
    """Whether the words ``a`` are, byte by byte, the words ``b``."""
    out = (end[a] - start[a]) == (end[b] - start[b])
    pairs = np.flatnonzero(out)
    ends = np.cumsum(end[a[pairs]] - start[a[pairs]])
    low = 0
    while low < len(pairs):
        done = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
        own = pairs[low:high]
        size = end[a[own]] - start[a[own]]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = data[np.repeat(start[a[own]], size) + place] == data[np.repeat(start[b[own]], size) + place]
        out[own] = np.logical_and.reduceat(equal, first)
        low = high
    return out
