"""Packing documents into sequences of a fixed length by bin completion with branch and bound.

A document of more than `capacity` tokens is cut into full pieces and a rest; nothing else is cut. Pieces are dealt
into blocks of about BLOCK pieces at random (by hash), and each block is packed on its own: beside thousands of
pieces, what a block wastes over one packing of everything is a fraction of its last sequence. Within a block the
multiset of lengths is all that matters, so the search runs on counts by length. What lies in the emptiest sequence of
each block is then packed anew, together, in blocks of the same size, until there is one block.

Search (after Korf's bin completion): best-fit decreasing gives the first incumbent. Then, always for the largest
piece left, the fillings of its sequence by any number of pieces are enumerated, dominated ones left out, those of
least waste first, and each is followed depth-first. A branch is cut when the space wasted so far leaves no packing
with fewer sequences than the incumbent's. The search ends at the lower bound or after NODES nodes beyond the first
packing; the incumbent is then the result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm._tables import cut

CAPACITY, END_ID = 2048, 0
BLOCK, NODES = 4_096, 1_500


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of lengths."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for x in sorted(lengths, reverse=True):
        i = bisect_left(room, (x, -1))
        if i < len(room):
            space, b = room.pop(i)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(x)
        if space - x:
            insort(room, (space - x, b))
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's L2."""
    total, best = sum(lengths), -(-sum(lengths) // capacity)
    order = sorted(lengths, reverse=True)
    sums = [0]
    for x in order:
        sums.append(sums[-1] + x)
    rising = [-x for x in order]
    for k in sorted({x for x in order if 2 * x <= capacity})[:64]:
        big = bisect_left(rising, -(capacity - k))  # pieces over capacity - k
        half = bisect_left(rising, -(capacity // 2))  # pieces over capacity / 2
        half = max(half, big)
        last = bisect_left(rising, -k + 1)  # pieces of k and more
        spare = (half - big) * capacity - (sums[half] - sums[big])
        best = max(best, half + max(0, -(-(sums[last] - sums[half] - spare) // capacity)))
    return best if total else 0


def _fillings(sizes: list[int], counts: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, tuple[int, ...] | None]]:
    """All fillings of `room` from the lengths at hand, as (waste, lengths), of least waste first; None for a dominated one.

    sizes is ascending and, with counts, the same at each next(). The sums that the largest lengths reach are kept as
    bits, a number for each count of lengths, so no walk ends without a filling; those without waste come as soon as
    the lengths seen reach the room. One piece that fills the room dominates every other filling.
    """
    own = sizes[bisect_left(sizes, room + 1) - 1 :: -1] if sizes and sizes[0] <= room else []
    if own and own[0] == room:
        yield 0, (room,)
        return
    held = [counts[x] for x in own]
    reach, mask = [1], (1 << room + 1) - 1

    def sums(k: int, target: int) -> Iterator[tuple[int, ...]]:
        """Fillings of target whose smallest length is own[k], then."""
        x = own[k]
        for c in range(1, min(held[k], target // x) + 1):
            rest = target - c * x
            if reach[k] >> rest & 1:
                for filling in below(k, rest):
                    yield (*filling, *[x] * c)

    def below(k: int, target: int) -> Iterator[tuple[int, ...]]:
        """Fillings of target from the k largest lengths."""
        if not target:
            yield ()
            return
        for i in range(bisect_left(reach, 1, 0, k + 1, key=lambda r: r >> target & 1) - 1, k):
            yield from sums(i, target)

    def undominated(filling: tuple[int, ...], waste: int) -> bool:
        """Whether no piece left fits the waste or the place of one or two pieces, with theirs or more."""

        def left(low: int, high: int) -> bool:
            for z in sizes[bisect_left(sizes, low) : bisect_left(sizes, high + 1)]:
                if counts[z] > filling.count(z):
                    return True
            return False

        if left(1, waste):
            return False
        kinds = sorted(set(filling))
        if waste and any(left(x + 1, x + waste) for x in kinds):
            return False
        return not any(left(x + y, x + y + waste) for a, x in enumerate(kinds) for y in kinds[a:] if x != y or filling.count(x) > 1)

    for k, x in enumerate(own):
        found, m, step = reach[-1], min(held[k], room // x), 1
        while m:
            step = min(step, m)
            found |= found << step * x
            m -= step
            step *= 2
        reach.append(found & mask)
        if reach[-1] >> room & 1:
            for filling in sums(k, room):
                yield 0, filling if undominated(filling, 0) else None
    found = reach[-1] & mask >> 1
    while found:
        target = found.bit_length() - 1
        if room - target > most_waste:
            return
        for filling in below(len(own), target):
            yield room - target, filling if undominated(filling, room - target) else None
        found ^= 1 << target


def pack(lengths: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Bins as lists of lengths, each at most capacity in sum."""
    full = [[x] for x in lengths if x >= capacity]
    lengths = [x for x in lengths if x < capacity]
    incumbent = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if len(incumbent) <= bound:
        return full + incumbent
    total = sum(lengths)
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    sizes = sorted(counts)

    def take(x: int) -> None:
        counts[x] -= 1
        if not counts[x]:
            sizes.pop(bisect_left(sizes, x))

    def give(x: int) -> None:
        if not counts[x]:
            insort(sizes, x)
        counts[x] += 1

    chosen: list[list[int]] = []
    stack: list[tuple[Iterator, int, int]] = []
    wasted, seen = 0, 0

    def branch() -> None:
        x = sizes[-1]
        take(x)
        budget = (len(incumbent) - 1) * capacity - total - wasted
        stack.append((iter(_fillings(sizes, counts, capacity - x, budget) if budget >= 0 else []), x, wasted))

    branch()
    while stack and seen < nodes + 2 * len(incumbent):
        fillings, x, before = stack[-1]
        if len(chosen) == len(stack):
            for y in chosen.pop()[1:]:
                give(y)
        found = next(fillings, None)
        if found is None:
            stack.pop()
            give(x)
            wasted = before
            continue
        seen += 1
        waste, filling = found
        if filling is None:
            continue
        wasted = before + waste
        for y in filling:
            take(y)
        chosen.append([x, *filling])
        if not sizes:
            if len(chosen) < len(incumbent):
                incumbent = [list(b) for b in chosen]
                if len(incumbent) <= bound:
                    break
            continue
        if wasted <= (len(incumbent) - 1) * capacity - total:
            branch()
    return full + incumbent


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each row of docs."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from postlode.llm._text import pieces
        from postlode.llm._tokens import PIECE_BYTES, encoder

        tokens = encoder(vocabulary, spaces=False)
        for batch in pieces(batches, "text", PIECE_BYTES):
            ids, at = tokens.encode(batch.column("text"))
            ids = np.insert(ids, at[1:], END_ID).astype("<u4")
            ends = at[1:] + np.arange(1, len(at))
            out: list[tuple] = []
            first = 0
            for doc_id, last in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                for k, start in enumerate(range(first, last, capacity)):
                    own = ids[start : min(last, start + capacity)]
                    out.append((doc_id, k, start - first, len(own), zlib.crc32(own)))
                first = last
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i != 1 else pa.int32()) for i, c in enumerate(zip(*out, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _pack_block(capacity: int, level: int):
    """Rows of a block with their sequence and offset; open: those of the emptiest sequence."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(rows["length"].tolist()):
            by_length.setdefault(x, []).append(i)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        bins = pack(rows["length"].tolist(), capacity)
        for b, filling in enumerate(bins):
            at = 0
            for x in filling:
                i = by_length[x].pop()
                sequence[i], offset[i] = b, at
                at += x
        emptiest = min(range(len(bins)), key=lambda b: (sum(bins[b]), b))
        rows["sequence_id"] = (16 * rows["block"].to_numpy() + level) * (1 << 20) + sequence
        rows["offset"] = offset
        rows["open"] = (sequence == emptiest) & (sum(bins[emptiest]) < capacity)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]]

    return run


def _pack_blocks(pieces: DataFrame, blocks: int, capacity: int, level: int) -> DataFrame:
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks))
    # Blocks are work, not bytes: their number decides that of the tasks, else a few small partitions would hold them.
    return pieces.withColumn("block", salt).repartition(min(blocks, 20_000), "block").groupBy("block").applyInPandas(_pack_block(capacity, level), _PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece.

    A null or empty text is the end id alone; a null doc_id is packed like any other; repeated rows are packed each;
    pieces of one length are told apart by doc_id, piece and checksum, and where these tie they are alike. An empty
    table gives an empty result. The number of blocks follows the number of pieces, so no task's share grows with the
    input, and blocks are even as pieces are dealt by the hash of all their columns and a running number.
    """
    pieces = cut(token_pieces(docs, capacity, vocabulary), "pieces")
    blocks = max(1, round(pieces.count() / BLOCK))
    done, level = [], 0
    while blocks > 1:
        packed = cut(_pack_blocks(pieces, blocks, capacity, level), "packed")
        done.append(packed.where("not open"))
        pieces = packed.where("open").drop("sequence_id", "offset", "open")
        # An open sequence has fewer than `capacity` pieces, so two blocks' make one block at most.
        blocks, level = max(1, min(blocks // 2, round(pieces.count() / BLOCK))), level + 1
    return reduce(DataFrame.unionByName, done, _pack_blocks(pieces, 1, capacity, level)).drop("open")
