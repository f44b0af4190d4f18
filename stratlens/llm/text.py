"""Vectorised helpers over the texts of an Arrow batch: words, word hashes, shingle sets.

All of them work on the UTF-8 bytes of many texts at once, so a task does a few numpy passes per
megabyte instead of a Python step per word. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))

# Word separators: space and the control characters 9 to 13.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """The first n of a fixed sequence of 64-bit integers."""
    start = np.uint64(seed * 0x632BE59BD9B4E019 % 2**64)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * _MIX[2])


_WEIGHTS = {"position": randoms(4096, 1), "shingle": randoms(SHINGLE, 2) | np.uint64(1)}


def _position_weights(n: int) -> np.ndarray:
    if n > len(_WEIGHTS["position"]):
        _WEIGHTS["position"] = randoms(2 * n, 1)
    return _WEIGHTS["position"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and the bytes they point into."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most that many bytes, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the place of each text's first word (one more than texts)."""
    base, end = int(offsets[0]), int(offsets[-1])
    part = data[base:end]
    if lower:
        part = _LOWER[part]
    inside = ~SEPARATOR[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1] - base
    begins = begins[begins < len(part)]
    first[begins] |= inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ends = np.append(starts[1:], len(part))
    place = np.arange(starts[0], len(part)) - np.repeat(starts, ends - starts)
    weights = _position_weights(int((ends - starts).max()) + 1)
    value = weights[place]
    value *= part[starts[0] :].astype(np.uint64) + np.uint64(1)
    value[~inside[starts[0] :]] = 0
    return mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offsets - base)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's five-word shingles in order; the whole sequence if it has fewer words.

    Also the place of each text's first shingle (one more than texts).
    """
    n = np.diff(firsts)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begins = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(n)), counts)
    at = firsts[:-1][text] + np.arange(begins[-1]) - begins[:-1][text]
    length = np.minimum(n, SHINGLE)[text]
    total = length.astype(np.uint64)
    for k in range(SHINGLE):
        has = length > k
        term = words[np.where(has, at + k, 0)] * _WEIGHTS["shingle"][k] if len(words) else total * np.uint64(0)
        total = total + np.where(has, term, np.uint64(0))
    return mix(total), begins


def shingle_sets(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes."""
    hashes, begins = shingle_hashes(*word_hashes(offsets, data, lower))
    return [np.unique(hashes[i:j]) for i, j in zip(begins[:-1], begins[1:], strict=True)]
