"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct shingles (WIDTH words, A-Z lower-cased) as 64-bit hashes. Its sketch has one
register for each of BUCKETS buckets: of the smallest hash in the bucket, the number of leading zeros and the next
MANTISSA bits, 16 bits in all (Yu and Weber, 2017). Empty buckets borrow from a filled one (optimal densification).

1. Equal sets are one class, named by its smallest doc_id; only one sketch of a class goes on.
2. Bands of ROWS registers are hashed; who shares a band is linked to the smallest of the band (a star, no pairs).
   Components of these links hold all pairs that share a band. A pair at the threshold shares none of the 32 bands
   with a chance of 5e-11.
3. Each component is joined exactly on its full sets: a prefix filter with rarest shingles first lists who may reach
   the threshold, the collision-corrected estimate from the sketches drops pairs more than six deviations below it,
   and the rest is verified. Pairs within what is already one component are not looked at: components, not pairs,
   are asked for. Larger components are cut into blocks by set size, of BLOCK documents and BLOCK_SHINGLES shingles at
   most (or one document), and all pairs of blocks whose sizes can match are joined as groups of their own, so what a
   group holds is bounded in documents and in bytes.
4. Components of the verified links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm._tables import cut
from postlode.llm._text import buffer, lowered, mix, pieces, span_hashes, spans, window_hashes
from postlode.llm.components import components

WIDTH, BUCKETS, MANTISSA, ROWS, BANDS, BLOCK, BLOCK_SHINGLES = 5, 128, 10, 4, 32, 6_000, 3_000_000
_SHIFT = np.uint64(57)
_REST = np.uint64((1 << 57) - 1)
_DONORS = np.stack([np.random.default_rng(i + 1).permutation(BUCKETS) for i in range(BUCKETS)])


def shingles(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles; fewer words than width are one shingle."""
    data, offsets = buffer(texts)
    data = lowered(data)
    starts, ends, words = spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    every = window_hashes(hashes, width)
    for a, b in zip(words[:-1], words[1:], strict=True):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            yield window_hashes(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a sorted, non-empty set of hashes: BUCKETS unsigned 16-bit registers."""
    at = np.searchsorted(found, np.arange(BUCKETS, dtype=np.uint64) << _SHIFT)
    inside = np.minimum(at, len(found) - 1)
    own = found[inside]
    filled = (at < len(found)) & ((own >> _SHIFT) == np.arange(BUCKETS, dtype=np.uint64))
    rest = own & _REST
    bits = np.frexp(rest.astype(np.float64))[1]
    mantissa = (rest >> np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out = (((57 - bits).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    if not filled.all():
        donor = _DONORS[np.arange(BUCKETS), filled[_DONORS].argmax(1)]
        out = np.where(filled, out, out[donor])
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    rows = sketch[:, : ROWS * BANDS].reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    packed = (rows << (np.arange(ROWS, dtype=np.uint64) * np.uint64(16))).sum(2, dtype=np.uint64)
    return mix(mix(packed) + np.arange(BANDS, dtype=np.uint64)[None, :])


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of disjoint sets of n and m elements are equal."""
    a, b = (np.maximum(np.asarray(x, float), 1)[..., None] / BUCKETS for x in (n, m))
    low = 2.0 ** -np.arange(1, 41)
    cell = low / (1 << MANTISSA)
    return (a * b * cell / (a + b) * (np.exp(-(a + b) * low) - np.exp(-(a + b) * 2 * low))).sum(-1)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard similarity from the share of equal registers, corrected for chance collisions."""
    by_chance = collisions(n, m)
    return (equal - by_chance) / (1 - by_chance)


def sketches(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (a digest of the set), registers (binary; null for an empty set), or text in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, d1, d2, regs = [], [], [], []
            for found in shingles(batch.column("text")):
                n.append(len(found))
                d1.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(mix(found).sum(dtype=np.uint64).view(np.int64)))
                if not with_text:
                    regs.append(registers(found).tobytes() if len(found) else None)
            last = {"text": batch.column("text")} if with_text else {"registers": pa.array(regs, pa.binary())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64())} | last)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, " + ("text string" if with_text else "registers binary"))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4_000):
            part = batch.slice(at, 4_000)
            ids = part.column("id").to_numpy()
            sketch = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(len(ids), BUCKETS)
            keys = band_keys(sketch).view(np.int64)
            yield pa.RecordBatch.from_pydict({"band": pa.array(keys.ravel()), "id": pa.array(np.repeat(ids, BANDS))})


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            r = self.up[at]
            if (self.up[r] == r).all():
                return r
            self.up[at] = self.up[r]

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def link_group(sets: list[np.ndarray], sketch: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that join all sets which the threshold joins, one fewer than sets at most.

    side: if given, only pairs with unequal sides are looked at. Exact: the prefix filter loses no pair.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((code, df[code], owner))
    code = code[order]
    first = np.concatenate(([0], np.cumsum(sizes)))
    rank = np.arange(len(code)) - first[owner]
    prefix = sizes - (percent * sizes + 99) // 100 + 1
    chosen = (rank < prefix[owner]) & (df[code] > 1)
    who, what = owner[chosen], code[chosen]
    by = np.lexsort((who, what))
    who, what = who[by], what[by]
    cuts = np.flatnonzero(np.append(True, what[1:] != what[:-1])) if len(what) else np.zeros(0, int)
    lists = [x for x in np.split(who, cuts[1:]) if len(x) > 1] if len(cuts) else []
    forest, links = _Forest(n), []
    seen: dict[int, set[int]] = {}
    mark = np.zeros(len(df), bool)
    for members in sorted(lists, key=len):
        for k, x in enumerate(members[:-1].tolist()):
            others = members[k + 1 :]
            root = forest.roots(members[k:])
            others = others[root[1:] != root[0]]
            if side is not None and len(others):
                others = others[side[others] != side[x]]
            near = (100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])) if len(others) else others
            others = others[near] if len(others) else others
            done = seen.setdefault(x, set())
            others = np.array([y for y in others.tolist() if y not in done], int)
            if not len(others):
                continue
            done.update(others.tolist())
            guess = estimate((sketch[others] == sketch[x]).mean(1), sizes[others], np.full(len(others), sizes[x]))
            margin = 6 * np.sqrt(percent / 100 * (1 - percent / 100) / np.minimum(BUCKETS, sizes[x]))
            others = others[guess >= percent / 100 - margin]
            if not len(others):
                continue
            mark[code[first[x] : first[x + 1]]] = True
            for y in others.tolist():
                both = int(mark[code[first[y] : first[y + 1]]].sum())
                if 100 * both >= percent * (sizes[x] + sizes[y] - both) and forest.union(x, y):
                    links.append((x, y))
            mark[code[first[x] : first[x + 1]]] = False
    return links


def _link(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        sketch = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(len(rows), BUCKETS)
        _, low, high = key
        side = rows["block"].to_numpy() if low != high else None
        ids = rows["id"].to_numpy()
        links = link_group(sets, sketch, percent, side)
        return pd.DataFrame({"u": ids[[a for a, _ in links]], "v": ids[[b for _, b in links]]}).astype("int64")

    return run


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = list(shingles(batch.column("text")))
        regs = [registers(x).tobytes() if len(x) else b"" for x in found]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "group": batch.column("group"), "low": batch.column("low"), "high": batch.column("high"), "block": batch.column("block"), "shingles": pa.array([x.tobytes() for x in found], pa.binary()), "registers": pa.array(regs, pa.binary())})


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of docs.

    Texts that are null or without words have n_shingles 0 and are linked with nothing. Rows without a doc_id are
    linked like others, but never name a component; where no member has a doc_id, component_id is null and all stay.
    Rows that share a doc_id are judged by their own text; if it is the smallest of several classes, these are one.
    """
    own = cut(sketches(docs), "sketches")
    classes = own.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.first("registers").alias("registers"))
    # A class without a doc_id goes by a hash of its digest, which names no component.
    inner = F.xxhash64("d1", "d2", "n_shingles", F.lit("no doc_id"))
    classes = cut(classes.withColumn("id", F.coalesce("first_id", inner)), "classes")
    bands = classes.select("id", "registers").mapInArrow(_bands, "band long, id long")
    stars = bands.groupBy("band").agg(F.min("id").alias("v"), F.max("id").alias("last")).where("v < last").select("band", "v")
    groups = components(bands.join(stars, "band").where("id <> v").select(F.col("id").alias("u"), "v"))
    grouped = groups.select(F.col("node").alias("id"), F.col("component").alias("group")).join(classes.select("id", "n_shingles").groupBy("id").agg(F.max("n_shingles").alias("n")), "id")
    # A block is a range of set sizes of one component, or a salted part of one; documents of a component are counted
    # by size first, so this too is a sum and not a window over documents. Each weighs its shingles, or an equal part
    # of the block if that is more.
    by_size = grouped.groupBy("group", "n").count().withColumn("weight", F.greatest("n", F.lit(BLOCK_SHINGLES // BLOCK)))
    from pyspark.sql import Window

    upto = F.sum(F.col("count") * F.col("weight")).over(Window.partitionBy("group").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by_size = by_size.withColumn("upto", upto).select("group", "n", "count", "weight", (F.col("upto") - F.col("count") * F.col("weight")).alias("before"))
    placed = grouped.join(by_size, ["group", "n"])
    spot = F.col("before") + F.pmod(F.xxhash64("id"), F.col("count")) * F.col("weight")
    placed = placed.withColumn("block", F.floor(spot / BLOCK_SHINGLES).cast("int"))
    blocks = placed.groupBy("group", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = blocks.alias("a"), blocks.select(F.col("group").alias("g"), F.col("block").alias("other"), F.col("least").alias("other_least")).alias("b")
    pairs = a.join(b, (F.col("group") == F.col("g")) & (F.col("block") <= F.col("other")) & (100 * F.col("most") >= percent * F.col("other_least"))).select("group", F.col("block").alias("low"), F.col("other").alias("high"))
    each = pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))
    members = placed.select("id", "group", "block").join(each, ["group", "block"]).select("id", "group", "low", "high", "block")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    # Rows that repeat a doc_id and its text are one member of their block.
    again = cut(own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")), "repeated-ids")
    if not again.isEmpty():
        texts = texts.join(again, "id", "left_anti").unionByName(texts.join(again, "id", "left_semi").dropDuplicates(["id", "text"]))
    unnamed = sketches(docs.where(F.col("doc_id").cast("long").isNull()), with_text=True).where("n_shingles > 0")
    unnamed = unnamed.select(inner.alias("id"), "text").dropDuplicates(["id"])
    texts = texts.join(members, "id").unionByName(unnamed.join(members, "id"))
    sets = texts.where("text is not null").mapInArrow(_with_shingles, "id long, group long, low int, high int, block int, shingles binary, registers binary").where("length(shingles) > 0")
    links = sets.groupBy("group", "low", "high").applyInPandas(_link(percent), "u long, v long")
    found = components(links)
    names = found.join(classes.select(F.col("id").alias("node"), "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("name"))
    found = found.join(names, "component").select("node", "name")
    joined = classes.join(found, F.col("id") == F.col("node"), "left").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n_shingles").alias("cn"), F.coalesce("name", "first_id").alias("component"))
    matched = own.drop("registers").join(joined, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn")), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return matched.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id; of rows that share it, the one of the
    smallest hash over all columns, so that reruns agree.

    Rows without a doc_id all stay: nothing tells which of them a verdict is about.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), percent).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(F.col("doc_id").alias("__id"), F.struct(*docs.columns).alias("__row"), F.xxhash64(*docs.columns).alias("__hash"))
    once = named.groupBy("__id").agg(F.min_by("__row", "__hash").alias("__row")).select("__row.*")
    return once.unionByName(docs.where("doc_id is null"))
