"""Words of many texts at once: numpy over the buffers of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer text is worked on alone.
CHUNK = 2 << 20
#: Bytes of words that are hashed together.
SPAN = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: 0-9, A-Z, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and for each text the number of the first word at or after its start."""
    inside = of_word[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]  # no word goes on in the next text
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, SPAN + 1)
        _POWERS["up"], _POWERS["down"] = _powers(n, int(_ODD)), _powers(n, pow(int(_ODD), -1, 2**64))
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes that doesn't depend on its place."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SPAN, side="right")))
        lo, hi = starts[a], ends[b - 1]
        up, down = powers(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        at, to = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64))
        a = b
    return out


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, texts' edges not minded; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    h = np.full(m, np.uint64(n))
    for k in range(n):
        h = h * _ODD + hashes[k : k + m]
    return mix(h)


class Lookup:
    """Sorted 64-bit keys with a bitmap of their first bits, which settles most misses."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[keys >> np.uint64(64 - self.BITS)] = True

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens that are keys, and the keys' numbers."""
        place = np.flatnonzero(self.bitmap[tokens >> np.uint64(64 - self.BITS)])
        if not len(place):
            return place, place
        at = np.minimum(np.searchsorted(self.keys, tokens[place]), len(self.keys) - 1)
        same = self.keys[at] == tokens[place]
        return place[same], at[same]
