"""A compressed full-text index over sequences of symbols: BWT, wavelet tree, backward search.

The wavelet tree keeps one bit vector a level, packed into 64-bit words with a count of ones before each word: about
1.5 bits a symbol and level. Many patterns are searched side by side, one symbol a step, so that Python's cost is per
step and not per symbol.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)

    def place(self, k: np.ndarray) -> np.ndarray:
        """Where the one number k lies (from 0); beyond the last, n."""
        at = np.maximum(np.searchsorted(self.before, k, "right") - 1, 0)
        rest = np.asarray(k - self.before[at])
        word, out = self.words[at].copy(), (at << 6).astype(np.int64)
        gone = rest >= np.bitwise_count(word)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & ((np.uint64(1) << np.uint64(half)) - np.uint64(1)))
            over = rest >= low
            rest = rest - np.where(over, low, 0)
            out = out + np.where(over, half, 0)
            word = np.where(over, word >> np.uint64(half), word)
        return np.where(gone, self.n, out)


class WaveletTree:
    """rank(symbol, i): occurrences of a symbol among the first i of a sequence (a wavelet matrix, top bit first)."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        now = sequence.astype(np.int32)
        for level in range(self.depth - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.first = np.searchsorted(now_key(now, self.depth), now_key(np.arange(sigma), self.depth))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            ones = bits.ones(at)
            at = np.where(one, zeros + ones, at - ones)
        return at - self.first[symbol]


def now_key(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Symbols by reversed bits, the order in which a wavelet matrix leaves them."""
    out = np.zeros(len(symbols), np.int64)
    for level in range(depth):
        out |= ((symbols.astype(np.int64) >> level) & 1) << (depth - 1 - level)
    return out


class FMIndex:
    """Over sequences, each followed by an end mark (symbol 0; the sequences' own symbols start at 1).

    Suffixes are sorted by their first `depth` symbols. A pattern of up to `depth` symbols is found by backward
    search; one of `depth` symbols is cut to depth - 1 by widen() before it is extended on the left again. The suffix
    array lives while the index is built only: what stays is the wavelet tree, two bit vectors that mark where suffixes
    of new first `depth` (or depth - 1) symbols begin, and the least value of each group of equal ones.
    """

    def __init__(self, sequences: list[np.ndarray], depth: int, values: np.ndarray):
        lengths = np.array([len(s) + 1 for s in sequences])
        text = np.zeros(int(lengths.sum()), np.int32)
        starts = np.cumsum(lengths) - lengths
        inside = np.ones(len(text), bool)
        inside[starts + lengths - 1] = False
        text[inside] = np.concatenate(sequences)
        n, sigma = len(text), int(text.max()) + 1
        # Prefix doubling; what lies behind an end mark never counts.
        left = (np.repeat(starts + lengths, lengths) - np.arange(n)).astype(np.int32)  # symbols to the end, mark included
        rank, span = text, 1
        while span < depth - 1:
            step = min(span, depth - 1 - span)
            rank = self._pair(rank, step, left)
            span += step
        full = self._pair(rank, 1, left)
        self.depth, self.n, self.sigma = depth, n, sigma
        suffixes = np.argsort(full, kind="stable").astype(np.int32)
        new = self._turns(full[suffixes])
        self.groups = BitVector(new)
        self.wide = BitVector(self._turns(rank[suffixes]))
        self.least = np.minimum.reduceat(np.repeat(values, lengths)[suffixes], np.flatnonzero(new))
        first = np.zeros(n, bool)
        first[starts] = True
        bwt = np.where(first[suffixes], 0, text[suffixes - 1])
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.tree = WaveletTree(bwt, sigma)

    @staticmethod
    def _pair(rank: np.ndarray, step: int, left: np.ndarray) -> np.ndarray:
        n = len(rank)
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        behind[left <= step] = 0
        return np.unique(rank.astype(np.int64) * (int(behind.max()) + 1) + behind, return_inverse=True)[1].astype(np.int32)

    @staticmethod
    def _turns(ordered: np.ndarray) -> np.ndarray:
        return np.append(True, ordered[1:] != ordered[:-1])

    def group(self, low: np.ndarray) -> np.ndarray:
        """The number of the group (equal first `depth` symbols) of the suffix at rank low."""
        return self.groups.ones(low + 1) - 1

    def extend(self, bound: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Backward search: from a bound of the suffixes that start with a pattern to that of symbol + pattern."""
        return self.counts[symbol] + self.tree.rank(symbol, bound)

    def widen(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes that share their first depth - 1 symbols with the suffix at rank low."""
        g = self.wide.ones(low + 1)
        return self.wide.place(g - 1), self.wide.place(g)

    def matches(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each sequence and each of its runs of `depth` symbols, the rank of the first suffix it starts, or -1.

        Matching statistics cut at depth: the sequences are streamed backwards, all side by side.
        """
        out = [np.full(max(0, len(s) - self.depth + 1), -1, np.int64) for s in sequences]
        order = sorted((i for i in range(len(sequences)) if len(out[i])), key=lambda i: -len(sequences[i]))
        sizes = np.array([len(sequences[i]) for i in order], np.int64)
        if not len(sizes):
            return out
        ends = np.cumsum(sizes)
        flat = np.concatenate([sequences[i] for i in order])
        low, high, length = np.zeros(len(order), np.int64), np.full(len(order), self.n), np.zeros(len(order), np.int64)
        found = np.full(len(flat), -1, np.int64)
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step, "left"))
            at = ends[:live] - 1 - step
            a, b, q = low[:live], high[:live], length[:live]
            long = q == self.depth
            wa, wb = self.widen(np.minimum(a, self.n - 1))
            a, b = np.where(long, wa, a), np.where(long, wb, b)
            q = np.where(long, self.depth - 1, q)
            symbol = flat[at]
            known = symbol < self.sigma
            symbol = np.where(known, symbol, 0)
            both = self.extend(np.concatenate((a, b)), np.concatenate((symbol, symbol)))
            a, b = both[:live], both[live:]
            q = q + 1
            lost = ~known | (a >= b)
            # Nothing has this symbol before the match: start anew behind it. Runs that end further left follow below.
            a, b, q = np.where(lost, 0, a), np.where(lost, self.n, b), np.where(lost, 0, q)
            low[:live], high[:live], length[:live] = a, b, q
            hit = q == self.depth
            found[at[hit]] = a[hit]
        for i, e, size in zip(order, ends, sizes, strict=True):
            out[i] = found[e - size : e - self.depth + 1]
        return out
