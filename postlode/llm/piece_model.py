"""Models of the sentencepiece library: normalisation that keeps its alignment, and BPE with byte fallback.

A model file is a protocol buffer with the pieces and their scores, and a normaliser: a map from character sequences to
their normal forms, compiled into a double-array trie. Normalisation takes the longest prefix that the trie knows (or
one character as it is), again and again, and notes for each byte of the normal form where in the source its prefix
began. Pieces cover stretches of the normal form, and the notes project each to the bytes of the source.

All work is done on many texts at once, as numpy arrays of bytes. Merging runs once on each distinct chunk: the normal
form is cut between two characters that stand side by side in no piece, which no merge can ever join.
"""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from postlode.llm._text import buffer
from postlode.llm._tokens import Encoder

SPACE = "▁"
_SPACE = np.frombuffer(SPACE.encode(), np.uint8)
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
#: Chunks of more characters are cut by pairs of characters, and merged with a heap.
LONG = 64
#: Chunks kept in a worker's cache.
CACHE = 300_000
ROWS = 20_000
NEVER = 1 << 60
#: The symbol that fills up rows.
PAD = -1


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields: integers, or bytes."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            out.append((key >> 3, varint()))
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        out.append((key >> 3, data[i : i + size]))
        i += size
    return out


@dataclass(frozen=True)
class Rules:
    """What a model says about normalisation."""

    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False


def rules_of(spec: bytes, suffix: bool = False) -> Rules:
    found = dict(fields(spec))
    return Rules(found.get(2, b""), bool(found.get(3, 1)), bool(found.get(4, 1)), bool(found.get(5, 1)), suffix)


class Normaliser:
    def __init__(self, rules: Rules):
        self.rules = rules
        size = int.from_bytes(rules.charsmap[:4], "little")
        self.trie = np.frombuffer(rules.charsmap, "<u4", size // 4, 4) if rules.charsmap else np.zeros(0, "<u4")
        self.forms = np.frombuffer(rules.charsmap, np.uint8, offset=4 + size) if rules.charsmap else np.zeros(0, np.uint8)
        self.ends = np.flatnonzero(self.forms == 0)

    def _matches(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start, the bytes of the longest prefix that the map knows (0: none) and the place of its normal form."""
        length, value = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        node = np.full(len(starts), self._child(self.trie[:1])[0], np.int64)
        depth = 0
        while len(live):
            inside = starts[live] + depth < stops[live]
            live, node = live[inside], node[inside]
            byte = data[starts[live] + depth]
            node = node ^ byte
            inside = node < len(self.trie)
            live, node, byte = live[inside], node[inside], byte[inside]
            unit = self.trie[node]
            same = (unit & np.uint32(0x800000FF)) == byte
            live, node, unit = live[same], node[same], unit[same]
            node = node ^ self._child(unit)
            depth += 1
            leaf = (unit >> np.uint32(8)) & np.uint32(1) == 1
            length[live[leaf]] = depth
            value[live[leaf]] = self.trie[node[leaf]] & np.uint32(0x7FFFFFFF)
        return length, value

    @staticmethod
    def _child(unit: np.ndarray) -> np.ndarray:
        return ((unit >> np.uint32(10)) << ((unit & np.uint32(512)) >> np.uint32(6))).astype(np.int64)

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normal forms of texts (valid UTF-8): bytes, their offsets, the source position of each byte, and of each text's end."""
        rules, n_texts = self.rules, len(offsets) - 1
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        owner = np.searchsorted(offsets, starts, "right") - 1
        length = np.diff(np.append(starts, len(data)))
        source, size = starts.copy(), length.copy()
        whole = data
        if len(self.trie) and len(starts):
            known, value = self._matches(data, starts, offsets[owner + 1])
            keep, at = np.ones(len(starts), bool), 0
            for i in np.flatnonzero(known > length):  # a prefix of several characters hides those within it
                if keep[i] and starts[i] >= at:
                    at = starts[i] + known[i]
                    keep[i + 1 : np.searchsorted(starts, at)] = False
            hit = known > 0
            whole = np.concatenate((data, self.forms))
            source[hit] = len(data) + value[hit]
            size[hit] = self.ends[np.searchsorted(self.ends, value[hit])] - value[hit]
            starts, owner, source, size = starts[keep], owner[keep], source[keep], size[keep]
        head, final = offsets[:-1].copy(), offsets[1:].copy()
        some = offsets[1:] > offsets[:-1]
        if rules.remove_extra_whitespaces and len(starts):
            blank = (size == 1) & (whole[np.minimum(source, len(whole) - 1)] == 32)
            # A text's first prefix that is no blank: what stands before it is dropped.
            first = np.searchsorted(owner, np.arange(n_texts))
            other = np.append(np.flatnonzero(~blank), len(blank))
            first = other[np.searchsorted(other, first)]
            stop = np.searchsorted(owner, np.arange(n_texts), "right")
            some &= first < stop
            final[~some] = offsets[:-1][~some]
            head[some] = starts[first[some]]
            keep = (size > 0) & some[owner] & (starts >= head[owner])
            starts, owner, source, size = starts[keep], owner[keep], source[keep], size[keep]
            after = whole[source + size - 1] == 32
            after = np.append([True], after[:-1]) | (np.append([-1], owner[:-1]) != owner) if len(owner) else after
            lead, live = np.zeros(len(owner), np.int64), np.flatnonzero(after)
            while len(live):
                live = live[(lead[live] < size[live]) & (whole[np.minimum(source[live] + lead[live], len(whole) - 1)] == 32)]
                lead[live] += 1
            source, size = source + lead, size - lead
        # The bytes of all prefixes one behind the other, and where each prefix began.
        ends = np.cumsum(size)
        take = np.repeat(source - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        out, origin = whole[take], np.repeat(starts, size)
        at = np.append(0, np.cumsum(np.bincount(owner, size, n_texts).astype(np.int64)))
        if rules.add_dummy_prefix and not rules.whitespace_as_suffix:
            out, origin = np.insert(out, at[:-1][some], 32), np.insert(origin, at[:-1][some], head[some])
            at = at + np.append(0, np.cumsum(some))
        if rules.escape_whitespaces:
            out, origin, at = _escaped(out, origin, at)
        if rules.remove_extra_whitespaces:
            out, origin, at, final = self._without_tail(out, origin, at, final)
        if rules.add_dummy_prefix and rules.whitespace_as_suffix:
            mark = _SPACE if rules.escape_whitespaces else np.frombuffer(b" ", np.uint8)
            where = np.repeat(at[1:][some], len(mark))
            out, origin = np.insert(out, where, np.tile(mark, int(some.sum()))), np.insert(origin, where, np.repeat(final[some], len(mark)))
            at = at + len(mark) * np.append(0, np.cumsum(some))
        return out, at, origin, final

    def _without_tail(self, out: np.ndarray, origin: np.ndarray, at: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, ...]:
        mark = SPACE.encode() if self.rules.escape_whitespaces else b" "
        keep, raw, lost = np.ones(len(out), bool), out.tobytes(), np.zeros(len(at), np.int64)
        for i in range(len(at) - 1):
            end = int(at[i + 1])
            while end - len(mark) >= at[i] and raw.startswith(mark, end - len(mark)):
                end -= len(mark)
                final[i] = origin[end]
            keep[end : at[i + 1]] = False
            lost[i + 1] = at[i + 1] - end
        return out[keep], origin[keep], at - np.cumsum(lost), final


def _escaped(out: np.ndarray, origin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with a SPACE in place of each blank."""
    blank = out == 32
    before = np.append(0, np.cumsum(blank))
    places = np.flatnonzero(blank) + 2 * before[:-1][blank]
    times = np.where(blank, 3, 1)
    out, origin = np.repeat(out, times), np.repeat(origin, times)
    for i, byte in enumerate(_SPACE):
        out[places + i] = byte
    return out, origin, at + 2 * before[at]


@lru_cache(2)
def pieces_of(path: str) -> PieceEncoder:
    """One encoder a worker process: its cache of chunks stays warm."""
    return PieceEncoder(path)


class PieceEncoder(Encoder):
    """Ids and source spans of a BPE model with byte fallback; other kinds of models are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = fields(f.read())
        found = [dict(fields(v)) for k, v in top if k == 1]
        trainer = dict(fields(next((v for k, v in top if k == 2), b"")))
        kinds = [p.get(3, NORMAL) for p in found]
        if trainer.get(3, 1) != BPE or not trainer.get(35) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or len(found) > 65_536:
            raise ValueError(f"{path}: only BPE models with byte fallback, without user-defined or unused pieces, of 65,536 ids at most")
        scores = np.array([np.frombuffer(p.get(2, bytes(4)), "<f4")[0] for p in found])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.names = [p.get(1, b"").decode() for p in found]
        self.kinds = np.array(kinds)
        self.by_piece = {w: (int(r), i) for i, (w, k, r) in enumerate(zip(self.names, kinds, rank, strict=True)) if k == NORMAL}
        self.rank = {w: r for w, (r, _) in self.by_piece.items()}
        self.by_byte = {int(w[3:5], 16): i for i, (w, k) in enumerate(zip(self.names, kinds, strict=True)) if k == BYTE}
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        self.rules = rules_of(next((v for k, v in top if k == 3), b""), bool(trainer.get(24)))
        self.normaliser = Normaliser(self.rules)
        #: Bytes of the normal form that each id stands for; a byte's piece stands for that one.
        self.width = np.array([1 if k == BYTE else len(w.encode()) for w, k in zip(self.names, kinds, strict=True)])
        self._merges()
        self.pairs = {w[i : i + 2] for w in self.by_piece for i in range(len(w) - 1)}
        self.joined = np.zeros((130, 130), bool)
        for a, b in self.pairs:
            self.joined[_kind(a), _kind(b)] = True
        self._forget()

    def _merges(self) -> None:
        """Pieces and the characters in them as symbols (the last: any other character), and all pairs of symbols that make a piece."""
        alone = sorted({c for w in self.by_piece for c in w} - set(self.by_piece))
        self.n_pieces = len(self.names)
        self.symbols = [w if w in self.by_piece and self.by_piece[w][1] == i else "" for i, w in enumerate(self.names)] + alone + [""]
        number = {w: i for i, w in enumerate(self.symbols) if w}
        self.by_point = np.full(0x110000, len(self.symbols) - 1, np.int32)
        found = []
        for w, i in number.items():
            if len(w) == 1:
                self.by_point[ord(w)] = i
            elif w in self.by_piece:
                found += [(number[w[:k]] * len(self.symbols) + number[w[k:]], self.rank[w], i) for k in range(1, len(w)) if w[:k] in number and w[k:] in number]
        found.sort()
        self.merge_key = np.array([x[0] for x in found] + [1 << 62])
        self.merge_rank = np.array([x[1] for x in found] + [NEVER])
        self.merge_symbol = np.array([x[2] for x in found] + [PAD])

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of chunks. Short ones of like length are merged together, a pair of each at a time."""
        out: list[list[int]] = [[]] * len(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self._long(texts[i])
        low = 0
        while low < LONG:
            high = max(1, 2 * low)
            some = np.flatnonzero((size > low) & (size <= high))
            for first in range(0, len(some), ROWS):
                rows = some[first : first + ROWS].tolist()
                self._merge_rows([texts[i] for i in rows], rows, out)
            low = high
        return out

    def _long(self, chunk: str) -> list[int]:
        """A long chunk is cut between characters that no piece joins; what is still long is merged with a heap."""
        cuts = [0, *(i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.pairs), len(chunk)]
        parts = [chunk[a:b] for a, b in itertools.pairwise(cuts)]
        short = iter(self.whole([x for x in parts if len(x) <= LONG]))
        return [i for x in parts for i in (next(short) if len(x) <= LONG else self._ids(self._heap(x)))]

    def _ids(self, symbols: list[str]) -> list[int]:
        return [i for x in symbols for i in ([self.by_piece[x][1]] if x in self.by_piece else [self.by_byte[b] for b in x.encode()])]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs of symbols in the table of merges; where there is no such merge, the last place, of rank NEVER."""
        key = np.where(right == PAD, -1, left * len(self.symbols) + right)
        at = np.searchsorted(self.merge_key, key)
        return np.where(self.merge_key[at] == key, at, len(self.merge_key) - 1)

    def _merge_rows(self, texts: list[str], rows: list[int], out: list[list[int]]) -> None:
        """A row of symbols a chunk: each round merges the best pair of every row, the leftmost of equals, and drops rows that have none."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        symbol = np.full((len(texts), int(size.max())), PAD, np.int64)
        symbol[np.arange(symbol.shape[1]) < size[:, None]] = self.by_point[points]
        pair = self._pair(symbol[:, :-1], symbol[:, 1:])
        row = np.arange(len(texts))
        while len(row):
            rank = self.merge_rank[pair]
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            live = rank[np.arange(len(row)), best] < NEVER if rank.shape[1] else np.zeros(len(row), bool)
            for i, line in zip(row[~live].tolist(), symbol[~live].tolist(), strict=True):
                line = [x for x in line if x != PAD]
                if max(line) >= self.n_pieces:
                    lost = iter([c for c in texts[i] if not self.symbols[self.by_point[ord(c)]]])
                    line = self._ids([self.symbols[x] or next(lost) for x in line])
                out[rows[i]] = line
            row, symbol, pair, best = row[live], symbol[live], pair[live], best[live]
            at = np.arange(len(row))
            whole = self.merge_symbol[pair[at, best]]
            columns = np.arange(symbol.shape[1] - 1)
            symbol = np.take_along_axis(symbol, columns + (columns > best[:, None]), 1)
            symbol[at, best] = whole
            columns = columns[:-1]
            pair = np.take_along_axis(pair, columns + (columns >= best[:, None]), 1)
            for k in (best - 1, best):
                inside = np.flatnonzero((k >= 0) & (k < len(columns)))
                pair[inside, k[inside]] = self._pair(symbol[inside, k[inside]], symbol[inside, k[inside] + 1])

    def _heap(self, chunk: str) -> list[str]:
        """The same for long chunks: pairs wait in a heap by rank and place."""
        symbols: list[str | None] = list(chunk)
        n, known = len(symbols), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, str]] = []

        def add(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                both = symbols[i] + symbols[j]
                if both in known:
                    heap.append((known[both], i, j, both)) if building else heapq.heappush(heap, (known[both], i, j, both))

        building = True
        for i in range(n - 1):
            add(i, i + 1)
        heapq.heapify(heap)
        building = False
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j], right[i] = both, None, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            add(left[i], i)
            add(i, right[i])
        return [s for s in symbols if s is not None]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin (with the end): at a text's start, and between kinds of characters that no piece joins."""
        n = len(data)
        high = np.where(data < 128, data, np.uint8(129))
        last, mark = high.copy(), np.zeros(n, bool)
        mark[: max(n - 2, 0)] = (data[:-2] == _SPACE[0]) & (data[1:-1] == _SPACE[1]) & (data[2:] == _SPACE[2])
        places = np.flatnonzero(mark)
        high[places], last[places + 2] = 128, 128
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        cut[1:n] |= ((data[1:] & 0xC0) != 0x80) & ~self.joined[last[:-1], high[1:]]
        return np.flatnonzero(cut)

    def encode_spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's begin (with the end), and the source bytes of each id's span within its text."""
        raw, bounds = buffer(texts)
        data, offsets, origin, final = self.normaliser.run(raw, bounds)
        none = np.zeros(0, np.int32)
        if not len(data):
            return none, np.zeros(len(bounds), np.int64), none, none
        cuts = self._cuts(data, offsets)
        chunks = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        if len(self.key) > CACHE:
            self._forget()
        start, size = self._known(coded.dictionary)
        codes = coded.indices.to_numpy()
        length = size[codes]
        ends = np.cumsum(length, dtype=np.int64)
        ids = self.ids[np.repeat(start[codes] - (ends - length), length) + np.arange(ends[-1])].astype(np.int32)
        at = np.append(0, ends)[np.searchsorted(cuts, offsets)]
        # Ids cover the normal forms without gaps, so their widths sum up to their places.
        stop = np.cumsum(self.width[ids])
        begin = stop - self.width[ids]
        count = np.diff(at)
        shift = np.repeat(bounds[:-1], count)
        after = np.where(stop == np.repeat(offsets[1:], count), np.repeat(final, count), origin[np.minimum(stop, len(data) - 1)])
        return ids, at, (origin[begin] - shift).astype(np.int32), (after - shift).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of one sequence of ids, as the library's decode() gives it."""
        strip = self.rules.add_dummy_prefix or self.rules.remove_extra_whitespaces
        if len(ids) and self.kinds[ids[0]] == NORMAL and not self.rules.remove_extra_whitespaces:
            raw = b"".join(map(self._texts.__getitem__, ids.tolist()))
            try:
                # Pieces are whole characters, so a broken run of byte pieces breaks the whole.
                return raw[strip and self.names[ids[0]].startswith(SPACE) :].decode()
            except UnicodeDecodeError:
                pass
        first = 0
        parts: list[bytes] = []
        run: list[bytes] = []
        texts, kinds = self._texts, self._kinds
        for i in ids.tolist():
            kind = kinds[i]
            if kind == BYTE:
                run.append(texts[i])
                continue
            if run:
                parts.append(_readable(b"".join(run)))
                run, first = [], 1
            if kind == NORMAL:
                if strip and not first and self.names[i].startswith(SPACE):
                    parts.append(texts[i][1:])
                    first = len(texts[i]) > 1 or not self.rules.remove_extra_whitespaces
                else:
                    parts.append(texts[i])
                    first = first or len(texts[i]) > 0
            elif kind == UNKNOWN:
                parts.append(self.unknown_text)
                first = 1
        if run:
            parts.append(_readable(b"".join(run)))
        return b"".join(parts).decode()

    def _forget(self) -> None:
        super()._forget()
        self._kinds = self.kinds.tolist()
        self._texts = [bytes([int(w[3:5], 16)]) if k == BYTE else w.replace(SPACE, " ").encode() if k == NORMAL else self.unknown_text if k == UNKNOWN else b"\xff" for w, k in zip(self.names, self._kinds, strict=True)]


def _kind(char: str) -> int:
    return ord(char) if ord(char) < 128 else 128 if char == SPACE else 129


def _readable(raw: bytes) -> bytes:
    """Bytes as UTF-8; each byte that begins no whole character becomes U+FFFD."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[i : i + n].decode()
                out.append(raw[i : i + n])
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)
