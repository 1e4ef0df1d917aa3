"""Words of many texts at once, on the bytes of Arrow string columns.

A word is a run of bytes outside of the six ASCII white-space characters (0x20, 0x09-0x0D). All functions work on
pieces of half a MB, so a worker's memory doesn't follow the size of Spark's batches; one text is never split.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES, STRETCH = 500_000, 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _offsets(array: pa.Array) -> np.ndarray:
    if not len(array):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column))
        ends = _offsets(array)
        first, n = 0, batch.num_rows
        while first < n:
            last = int(np.searchsorted(ends, ends[first] + most, "right")) - 1
            last = min(n, max(first + 1, last))
            yield batch.slice(first, last - first)
            first = last
        del batch, array
        pa.default_memory_pool().release_unused()


def buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is empty."""
    if array.null_count:
        array = array.fill_null("")
    offsets = _offsets(array)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (with the total at the end)."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) if len(data) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False])) if len(data) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (spans in order). Long data are hashed stretch by stretch, to the same values."""
    if len(data) <= STRETCH:
        return _span_hashes(data, starts, ends)
    out = np.empty(len(starts), np.uint64)
    turns = np.append(np.searchsorted(starts, np.arange(0, len(data), STRETCH)), len(starts))
    for a, b in itertools.pairwise(turns.tolist()):
        if a < b:
            low = starts[a]
            out[a:b] = _span_hashes(data[low : ends[b - 1]], starts[a:b] - low, ends[a:b] - low)
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(1 << max(12, int(len(data)).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def blanks(data: np.ndarray) -> np.ndarray:
    """White space as 0x20, all other bytes as they are."""
    return np.where(_SPACE[data], np.uint8(32), data)


_STEPS = [np.uint64(pow(_BASE, i + 1, 1 << 64)) for i in range(64)]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbouring words; runs that cross texts are the caller's to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _STEPS[0]
    for i in range(1, width):
        out = out + words[i : i + n] * _STEPS[i]
    return mix(out)
