"""Words of whole texts as 64-bit hashes, a batch of texts at a time, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII white space parts words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
KEEP = np.arange(256, dtype=np.uint8)
LOWER = KEEP.copy()
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes of texts that ``offsets`` part."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A hash of each stretch of bytes; work goes in blocks of about ``block`` bytes."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        low = int(starts[k])
        n = max(k + 1, int(np.searchsorted(ends, low + block, "right")))
        part = data[low : int(ends[n - 1])]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        a, b = starts[k:n] - low, ends[k:n] - low
        out[k:n] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * STEP)
        k = n
    return out


def batch_words(texts: pa.Array, fold: np.ndarray = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and each text's first place among them (one more at the end).

    Null and empty texts have no words.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = fold[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    starts, ends = spans(data, offsets - offsets[0])
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets - offsets[0])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, wherever texts begin or end."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for k in range(1, n):
        out *= STEP
        out += words[k : k + m]
    return mix(out)
