"""Ids of the installed public tokenizers, encoded chunk by chunk through a cache.

Both tokenizers split a text by a pattern before they merge letters, and no token spans two of its matches. Texts are
cut where the pattern is sure to cut: around white space, and between an ASCII letter and ASCII punctuation other than
an apostrophe. Equal chunks are encoded once as long as they stay in the cache. Texts with white space on which the
pattern and this module might differ, and those that hold the string of an added token, are encoded whole. Either way
all ids come from the tokenizers library, as it gives them with add_special_tokens=False: the string of a special token
in a text is that token.
"""

from __future__ import annotations

import itertools
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from postlode.llm._text import buffer, lowered, span_hashes

#: White space (or what some definitions take for it) other than space, \t, \n, \r.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028-\u2029\u202f\u205f-\u2060\u3000\ufeff]")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT = np.zeros(256, bool)
_POINT[33:48] = _POINT[58:65] = _POINT[91:97] = _POINT[123:127] = True
_POINT[39] = False
CACHE = 800_000
AT_ONCE = 10_000
PIECE_BYTES = 4_000_000


@lru_cache(2)
def encoder(path: str, spaces: bool) -> Encoder:
    """One encoder a worker process: loading the vocabulary costs more than a small task, and the cache stays warm."""
    return Encoder(path, spaces)


class Encoder:
    """Ids as unsigned 16-bit integers (both vocabularies have fewer than 65,536 ids).

    spaces: a single space belongs to the word behind it, as in byte-level BPE; else white space has no ids and
    letters are lower-cased by the tokenizer.
    """

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.I)
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids do not fit 16 bits")
        self.spaces = spaces
        self._forget()

    def whole(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), AT_ONCE):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
        return out

    def _forget(self) -> None:
        """The cache: chunks by 128 bits of hash, in order of the first 64, and where their ids lie in one array."""
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u2")

    def _known(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of each of some distinct chunks, after encoding those that are new."""
        data, offsets = buffer(chunks)
        key = span_hashes(data, offsets[:-1], offsets[1:])
        check = span_hashes(data ^ np.uint8(0x5A), offsets[:-1], offsets[1:])
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), bool)
        start, size = np.zeros(len(key), np.int32), np.zeros(len(key), np.int32)
        start[hit], size[hit] = self.start[at[hit]], self.size[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            found = self.whole(chunks.take(pa.array(new)).to_pylist())
            size[new] = np.fromiter(map(len, found), np.int32, len(found))
            start[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
            self.ids = np.concatenate((self.ids, np.fromiter(itertools.chain.from_iterable(found), "<u2")))
            new = new[np.argsort(key[new], kind="stable")]
            place = np.searchsorted(self.key, key[new])
            for name, values in (("key", key), ("check", check), ("start", start), ("size", size)):
                setattr(self, name, np.insert(getattr(self, name), place, values[new]))
        return start, size

    def _bounds(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        blank, n = _BLANK[data], len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        cut = first.copy()
        turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if self.spaces:
            into = turn[blank[turn]]
            word = turn[~blank[turn]]
            cut[into] = True
            word = word[~first[word]]
            cut[word - 1] = True  # the last blank of a run: its own chunk, or with the word if it's a space
            cut[word[data[word - 1] != 32]] = True
        else:
            cut[turn] = True
        cut[1:n] |= _LETTER[data[:-1]] & _POINT[data[1:]]
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (with the end). Null and empty texts have none."""
        odd = [i for i, x in enumerate(texts.to_pylist()) if x and (_ODD.search(x) or self.added.search(x))]
        if odd:
            mask = np.ones(len(texts), bool)
            mask[odd] = False
            ids, at = self.encode(texts.filter(pa.array(mask)))
            plain = iter(np.split(ids, at[1:-1]) if len(at) > 1 else [])
            special = iter(np.array(x, "<u2") for x in self.whole([texts[i].as_py() for i in odd]))
            each = [next(plain if ok else special) for ok in mask]
            return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        data, offsets = buffer(texts)
        if not len(data):
            return np.zeros(0, "<u2"), np.zeros(len(offsets), np.int64)
        if not self.spaces:
            data = lowered(data)
        bounds = self._bounds(data, offsets)
        chunks = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        if len(self.key) > CACHE:
            self._forget()
        # A text has fewer ids than bytes, and an Arrow string column fewer than 2^31 of these.
        start, size = self._known(coded.dictionary)
        codes = coded.indices.to_numpy()
        length = size[codes]
        ends = np.cumsum(length, dtype=np.int32)
        at = np.repeat(start[codes] - (ends - length), length)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], np.concatenate(([0], ends)).astype(np.int64)[np.searchsorted(bounds, offsets)]
