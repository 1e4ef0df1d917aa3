"""Removing passages that an earlier document has, with compressed FM-indexes over shards.

A window is WINDOW words. Two equal windows select the same anchor: the run of ANCHOR words with the smallest hash.

1. Each document is cut into runs of windows with one anchor (about 22 windows each, 43 at most). Anchors that occur in
   one doc_id only are dropped by a sum over all anchors: their windows match nothing elsewhere.
2. Of runs with equal words one is kept, with the smallest doc_id that has it.
3. Runs go to the shard of their anchor, so all runs that may hold an equal window meet in one shard. Anchors with
   more than HOT different runs (the borders of a passage that a large part of all documents share) are cut further,
   into windows: equal ones become one row by a sum, which goes to the shard of its own hash. Shards thus stay near a
   size that the input doesn't change.
4. A shard builds the FM-index of its runs and streams them against it; every window's interval of suffixes gives the
   smallest doc_id that has the window.
5. Each occurrence of a run removes the words of those windows whose smallest doc_id is below its own.

Joins by anchor, run or window have a written table on both sides, so that Spark's skew join can split a frequent key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm._tables import cut, drop
from postlode.llm._text import _powers, blanks, buffer, mix, pieces, span_hashes, spans, window_hashes
from postlode.llm.fm_index import FMIndex

WINDOW, ANCHOR, SHARD_RUNS, HOT = 50, 8, 3_000, 2_000
_SLOT, SEGMENT = np.uint64(26), 1 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _chosen(grams: np.ndarray, width: int) -> np.ndarray:
    """For each `width` neighbouring grams the place of the smallest, the first of equal ones; by segments, whatever their number."""
    out = np.empty(len(grams) - width + 1, np.int64)
    for a in range(0, len(out), SEGMENT):
        own = grams[a : a + SEGMENT + width - 1]
        packed = ((own >> _SLOT) << _SLOT) | np.arange(len(own), dtype=np.uint64)
        out[a : a + SEGMENT] = a + (_sliding_min(packed, width) & np.uint64((1 << int(_SLOT)) - 1)).astype(np.int64)
    return out


def runs(texts: pa.Array, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """text number, anchor hash, digest of the words, first window, number of windows: of each run of each text."""
    data, offsets = buffer(texts)
    starts, ends, words = spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    if len(hashes) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    grams = window_hashes(hashes, anchor)
    chosen = _chosen(grams, window - anchor + 1)
    doc = np.searchsorted(words, np.arange(len(chosen)), "right") - 1
    whole = np.arange(len(chosen)) + window <= words[doc + 1]
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])) & whole
    first = np.flatnonzero(new)
    ids = np.cumsum(new)[whole] - 1
    count = np.bincount(ids, minlength=len(first))
    up, down = _powers(1 << max(12, int(len(hashes)).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])))
    last = first + count + window - 1
    digest = mix((total[last] - total[first]) * down[first] + count.astype(np.uint64))
    return doc[first], grams[chosen[first]], digest, first - words[doc[first]], count


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        doc, anchor, digest, first, count = runs(batch.column("text"))
        take = pa.array(doc)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(take), "key": batch.column("key").take(take), "anchor": pa.array(anchor.view(np.int64)), "digest": pa.array(digest.view(np.int64)), "first": pa.array(first, pa.int32()), "windows": pa.array(count, pa.int32())})


_RUN = ("anchor", "digest", "first", "windows", "low", "high")


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Bytes and words (starts, ends) of the texts, and the fields of all their runs, `first` as a number among these words."""
    data, offsets = buffer(batch.column("text"))
    starts, ends, words = spans(data, offsets)
    own = batch.column("own")
    flat = own.flatten()
    runs = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in _RUN}
    runs["first"] = runs["first"] + np.repeat(words[:-1], own.value_lengths().to_numpy(zero_copy_only=False))
    return data, starts, ends, runs


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the listed runs of each text."""
    for batch in pieces(batches):
        data, starts, ends, own = _listed(batch)
        last = ends[own["first"] + own["windows"] + WINDOW - 2]
        words = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(starts[own["first"]], last, strict=True)]
        yield pa.RecordBatch.from_pydict({"a": own["anchor"], "b": own["digest"], "low": own["low"], "high": own["high"], "words": pa.array(words, pa.binary())})


def _extract_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the listed runs of each text, with 128 bits of hash (a, b)."""
    for batch in pieces(batches):
        data, starts, ends, own = _listed(batch)
        for k in range(0, len(own["first"]), 200):
            part = {c: v[k : k + 200] for c, v in own.items()}
            each = np.repeat(np.arange(len(part["first"])), part["windows"])
            at = np.arange(len(each)) - np.repeat(np.cumsum(part["windows"]) - part["windows"], part["windows"])
            first = part["first"][each] + at
            words = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(starts[first], ends[first + WINDOW - 1], strict=True)]
            hashes = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in words), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": hashes[:, 0].copy(), "b": hashes[:, 1].copy(), "anchor": part["anchor"][each], "digest": part["digest"][each], "at": at, "low": part["low"][each], "high": part["high"][each], "words": pa.array(words, pa.binary())})


def _search(rows: pa.Table) -> pa.Table:
    """For each run (a, b) of a shard, stretches of windows (from, length) whose smallest doc_id is low."""
    rows = rows.sort_by([("a", "ascending"), ("b", "ascending")])
    data, offsets = buffer(rows.column("words").combine_chunks().cast(pa.string()))
    starts, ends, cuts = spans(data, offsets)
    symbols = (np.unique(span_hashes(data, starts, ends), return_inverse=True)[1] + 1).astype(np.int32)
    sequences = np.split(symbols, cuts[1:-1])
    index = FMIndex(sequences, WINDOW, rows.column("low").to_numpy())
    high = rows.column("high").to_numpy()
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i, found in enumerate(index.matches(sequences)):
        least = index.least[index.group(found)]
        turn = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        stop = np.append(turn[1:], len(least))
        use = least[turn] < high[i]
        for column, values in zip(out, (np.full(use.sum(), i), turn[use], (stop - turn)[use], least[turn[use]]), strict=True):
            column.append(values)
    i, first, length, low = (np.concatenate(c).astype(np.int64) for c in out)
    return pa.table({"a": rows.column("a").to_numpy()[i], "b": rows.column("b").to_numpy()[i], "from": first, "length": length, "low": low})


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = buffer(batch.column("text"))
        starts, ends, words = spans(data, offsets)
        own = batch.column("stretches").fill_null([])
        flat, before = own.flatten(), np.repeat(words[:-1], own.value_lengths().to_numpy(zero_copy_only=False))
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, before + flat.field("start").to_numpy(zero_copy_only=False), 1)
        np.add.at(cover, before + flat.field("end").to_numpy(zero_copy_only=False), -1)
        stay = np.cumsum(cover[:-1]) == 0
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
        # Each text gets a blank behind it, and each word that stays is taken with the byte behind it.
        padded = blanks(np.insert(data, offsets[1:], 32))
        mask = np.zeros(len(padded) + 1, np.int8)
        mask[(starts + text)[stay]] += 1
        mask[(ends + text)[stay] + 1] -= 1
        out = padded[np.cumsum(mask[:-1], dtype=np.int8) > 0].tobytes()
        n = len(offsets) - 1
        total, kept = np.diff(words), np.bincount(text[stay], minlength=n)
        size = np.bincount(text[stay], (ends - starts + 1)[stay], n).astype(np.int64)
        at = np.cumsum(size) - size
        texts = [out[a : a + max(0, b - 1)] for a, b in zip(at.tolist(), size.tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(total - kept, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, end: stretches of words (end excluded) to remove. docs: doc_id, text, key, no nulls."""
    spark = docs.sparkSession
    every = cut(docs.mapInArrow(_find_runs, "doc_id long, key long, anchor long, digest long, first int, windows int"), "runs")
    shared = cut(every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "anchors")
    # Rows that repeat a doc_id and its text bring the same runs: these count once, and one of the texts is looked at.
    found = cut(every.join(shared, "anchor").distinct(), "shared-runs")
    again = cut(every.where("first = 0").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "repeated-rows")
    drop(every)
    if not again.isEmpty():
        once = docs.join(again, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
        docs = docs.join(again, ["doc_id", "key"], "left_anti").unionByName(once)
    place = F.struct("doc_id", "key", "first", "windows")
    kinds = cut(found.groupBy("anchor", "digest").agg(F.min(place).alias("place"), F.max("doc_id").alias("high")), "run-kinds")
    hot = cut(kinds.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot-anchors")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def words(runs: DataFrame, extract, schema: str) -> DataFrame:
        run = F.struct("anchor", "digest", "place.first", "place.windows", F.col("place.doc_id").alias("low"), "high").alias("run")
        # A document's runs are no more than its windows.
        per_doc = runs.select("place.doc_id", "place.key", run).groupBy("doc_id", "key").agg(F.collect_list("run").alias("own"))
        return docs.join(per_doc, ["doc_id", "key"]).select("text", "own").mapInArrow(extract, schema)

    def searched(rows: DataFrame, runs: int) -> DataFrame:
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(max(1, runs // SHARD_RUNS, most))))
        return dealt.groupBy("shard").applyInArrow(lambda t: _search(t.drop_columns(["shard"])), "a long, b long, `from` long, length long, low long")

    cold = kinds.join(hot, "anchor", "left_anti")
    stretches = searched(words(cold, _extract, "a long, b long, low long, high long, words binary"), kinds.count()).withColumnsRenamed({"a": "anchor", "b": "digest"})
    if not hot.isEmpty():
        parts = cut(words(kinds.join(hot, "anchor", "left_semi"), _extract_windows, "a long, b long, anchor long, digest long, at long, low long, high long, words binary"), "hot-windows")
        once = parts.groupBy("a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("words").alias("words")).where("low < high")
        least = cut(searched(once, parts.count()), "window-owners")
        stretches = stretches.unionByName(parts.drop("low", "high").join(least, ["a", "b"]).select("anchor", "digest", F.col("at").alias("from"), "length", "low"))
    hits = found.join(cut(stretches, "stretches"), ["anchor", "digest"]).where("low < doc_id")
    return hits.select("doc_id", "key", (F.col("first") + F.col("from")).cast("int").alias("start"), (F.col("first") + F.col("from") + F.col("length") + WINDOW - 1).cast("int").alias("end"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: one row a row of docs.

    Null and empty texts have no words. Rows without a doc_id are returned whole and make nothing else go. Rows that
    share a doc_id do not count as earlier for each other; each loses what its own text repeats.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.where("doc_id is not null").withColumn("key", F.xxhash64("text"))
    per_doc = repeated_stretches(named).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("stretches"))
    marked = named.join(per_doc, ["doc_id", "key"], "left").select("doc_id", "text", "stretches")
    rest = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(marked.schema["stretches"].dataType).alias("stretches"))
    return marked.unionByName(rest).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")
