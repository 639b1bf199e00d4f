"""Sets of word n-grams of many texts at once, as 64-bit hashes in numpy.

A word's hash is mix(sum T[b[j]] P^j + length) modulo 2^64, taken for all words of a buffer from prefix sums; an n-gram's is
folded from its words'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_TABLE = np.random.default_rng(85).integers(0, 2**64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15
#: Bytes hashed at a time, and bytes of texts taken together.
_SEGMENT, _TOGETHER = 1 << 20, 2 << 20


def _powers(base: int) -> np.ndarray:
    out = np.full(_SEGMENT + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_ODD), _powers(pow(_ODD, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all white-space words of texts, and each text's first word (one more entry than texts)."""
    inside = ~_BLANK[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & (border[:-1] | np.r_[True, ~inside[:-1]]))
    ends = np.flatnonzero(inside & (border[1:] | np.r_[~inside[1:], True])) + 1
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + _SEGMENT, side="right"))
        if j <= i:  # a word longer than a segment
            word = np.zeros(1, np.uint64)
            for at in range(low, int(ends[i]), _SEGMENT):
                part = data[at : min(at + _SEGMENT, int(ends[i]))]
                word = mix(word * np.uint64(3) + (_TABLE[part] * _UP[: len(part)]).sum(dtype=np.uint64))
            out[i] = mix(word + np.uint64(ends[i] - low))[0]
            i += 1
            continue
        part = data[low : int(ends[j - 1])]
        sums = np.r_[np.uint64(0), np.cumsum(_TABLE[part] * _UP[: len(part)], dtype=np.uint64)]
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
        i = j
    return out, np.searchsorted(starts, offsets)


def gram_sets(texts: pa.Array, salts: np.ndarray, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Some texts at a time: the place of the first, and each one's sorted distinct hashes of n words in a row (none under n
    words; a null text is empty).  Texts of different salts (uint64) share none."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _TOGETHER, side="right")) - 1)
        words, first = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        count = max(0, len(words) - n + 1)
        grams = np.full(count, n, np.uint64)
        for k in range(n):
            grams = mix(grams * np.uint64(_ODD) + words[k : k + count])
        yield i, [np.unique(mix(grams[low : max(low, high - n + 1)] ^ salt)) for low, high, salt in zip(first[:-1].tolist(), first[1:].tolist(), salts[i:j])]
        i = j
