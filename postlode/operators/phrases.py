"""Many phrases in many texts: hashes of runs of bytes, in place of testing every phrase on every text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.staging import written

#: Bits of the bitmap that runs of the texts are looked up in: 4 MB, whatever the number of phrases.
FILTER_BITS = 1 << 25
#: Bytes of texts whose hashes are in memory at once (or as many as the longest phrase has): they stay in a core's cache.
STEP = 1 << 16
_ODD = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def _mixed(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    h = h * _ODD[0]
    h += other
    h ^= h >> np.uint32(15)
    h *= _ODD[1]
    return h


def _hashes(data: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """size, hash of the size bytes from each place on: for sizes 1, 2, 4 and so on up to longest, each made of the one before."""
    size, h = 1, (data.astype(np.uint32) + np.uint32(1)) * _ODD[2]
    while size <= longest and len(h):
        yield size, h
        h = _mixed(h[:-size], h[size:])
        size *= 2


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    """Places in the bitmap; kind: the length of a whole phrase, or the negative size of the run it begins with."""
    h = h ^ np.uint32((kind * int(_ODD[0]) ^ int(_ODD[2])) % (1 << 32))
    h ^= h >> np.uint32(16)
    h *= _ODD[1]
    h >>= np.uint32(7)
    return h


def _whole(h: np.ndarray, at: np.ndarray, length: int, size: int) -> np.ndarray:
    """Places in the bitmap of `length` bytes from `at` on: two runs of more than half the length hold all of them."""
    return _slots(_mixed(h[at], h[at + (length - size)]), length)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, one after another, and where each begins (and the last ends)."""
    column = column.cast(pa.large_binary())
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in the bitmap of phrases: of the runs of 1, 2, 4 and so on bytes that each begins with, and of its whole."""
    for batch in batches:
        if len(batch):
            data, starts = _bytes(batch.column(0))
            lengths = np.diff(starts)
            for size, h in _hashes(data, int(lengths.max())):
                slots = [_slots(h[starts[:-1][lengths >= size]], -size)]
                for length in np.unique(lengths[(lengths >= size) & (lengths < 2 * size)]).tolist():
                    slots.append(_whole(h, starts[:-1][lengths == length], length, size))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots)).astype(np.int64))], ["slot"])


def _lookup(bits: np.ndarray, lengths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """__id, __phrase: for each text its distinct runs of bytes that the bitmap takes for phrases: all that are, and a few others."""
    longest = max(lengths, default=0)
    step = max(STEP, longest)
    # Most places are ruled out by one byte for each 32 bits, which takes a quarter of the memory.
    some = bits.view(np.uint32) != 0

    def marked(slots: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(some.take((slots >> np.uint32(5)).astype(np.intp), mode="clip"))
        slots = slots[at]
        return at[(bits[slots >> np.uint32(3)] >> (slots & np.uint32(7)).astype(np.uint8) & np.uint8(1)) != 0]

    def near(data: np.ndarray, ends: np.ndarray, first: int, found: set[tuple[int, bytes]]) -> None:
        """Adds what begins in the step bytes from first on."""
        part = data[first : first + step + longest - 1]
        raw = part.tobytes()
        at = None
        for size, h in _hashes(part, longest):
            if 2 * size <= lengths[0]:
                continue
            # What begins like no phrase at one size does not at the next.
            if at is None:
                at = marked(_slots(h[:step], -size))
            else:
                at = at[at < len(h)]
                at = at[marked(_slots(h[at], -size))]
            row = np.searchsorted(ends, first + at, "right")
            left = ends[row] - first - at
            for n in (n for n in lengths if size <= n < 2 * size):
                fits = np.flatnonzero(left >= n)
                hit = fits[marked(_whole(h, at[fits], n, size))]
                found.update((r, raw[i : i + n]) for r, i in zip(row[hit].tolist(), at[hit].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not lengths:
                continue
            data, starts = _bytes(batch.column(1))
            ends, done, found = starts[1:], 0, set()
            for first in range(0, len(data), step):
                near(data, ends, first, found)
                # Texts that end here are complete; another one keeps what it has found.
                now = int(np.searchsorted(ends, first + step, "right"))
                if now > done:
                    out = [x for x in found if x[0] < now]
                    found = {x for x in found if x[0] >= now}
                    done = now
                    ids = batch.column(0).take(pa.array([r for r, _ in out], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([p for _, p in out], pa.binary())], ["__id", "__phrase"])

    return run


def _distinct(phrases: DataFrame, phrase: str) -> DataFrame:
    return written(phrases.select(F.col(phrase).alias("__phrase")).where("__phrase <> ''").distinct(), "phrases")


def _found(t: DataFrame, known: DataFrame) -> DataFrame:
    """__id, __phrase: for each row of t (__id, __text) the distinct phrases of known that it holds, and few runs that are none.

    A text is read once and moves nowhere. Where its bytes begin like a phrase, by the hash of a run of 1, 2, 4 or more
    bytes, the bytes of each length of a phrase are looked up by two such hashes. What comes out are pieces of the text
    itself, so that an equal join with known confirms them.
    """
    marks = known.mapInArrow(_marks, "slot long")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    # At most 4 MB, whatever the number of phrases, and one number for each length.
    for r in marks.groupBy(F.floor(F.col("slot") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(32768))).alias("bits")).collect():
        bits[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    lengths = sorted(r[0] for r in known.select(F.octet_length("__phrase")).distinct().collect())
    return t.select("__id", "__text").mapInArrow(_lookup(bits, lengths), "__id long, __phrase binary").withColumn("__phrase", F.col("__phrase").cast("string"))


def occurrences(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """The distinct pairs (text, phrase) of which the text holds the phrase, as they are written; the caller normalises.

    Neither side has a limit. Null and empty phrases are in no text, null texts hold none; repeated rows count once.
    Each pair carries its whole text: where only numbers are asked for, counts() moves no text.
    """
    t = texts.select(F.col(text).alias("__text")).where("__text <> ''").distinct()
    t = written(t.withColumn("__id", F.monotonically_increasing_id()), "texts")
    known = _distinct(phrases, phrase)
    met = _found(t, known).join(known, "__phrase", "left_semi")
    # Pairs are many more than the size of the files behind them tells, so neither they nor the texts may be broadcast.
    return t.join(met.hint("merge"), "__id").select(F.col("__text").alias(text), F.col("__phrase").alias(phrase))


def counts(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, name: str) -> DataFrame:
    """phrase, and by name the number of rows of texts that hold it (phrases that no row holds are not there)."""
    t = texts.select(F.monotonically_increasing_id().alias("__id"), F.col(text).alias("__text")).where("__text <> ''")
    known = _distinct(phrases, phrase)
    # Counted before they are confirmed: a task sends each phrase once, not once a text.
    found = _found(t, known).groupBy("__phrase").agg(F.count(F.lit(1)).alias(name))
    return found.join(known.hint("merge"), "__phrase").select(F.col("__phrase").alias(phrase), name)
