"""Importance resampling towards a target: hashed n-gram features, their CRCs composed by algebra, Gumbel top-k.

The CRC-32 of a string is linear over GF(2): crc(A + B) = shift(crc(A), length of B) xor crc(B), where shift by n bytes
is a 32 x 32 matrix of bits. Each distinct word's CRC is computed once a piece of text; the CRC of an n-gram comes from
the CRC of the (n-1)-gram, the length of its last word and that word's CRC, so no n-gram string is ever made. A matrix
is applied as four look-ups of a byte each; matrices of lengths up to NEAR are tables, longer ones are products of the
matrices of powers of two.

1. One pass over the documents and one over the target count features per bucket. A task sums its rows up to one count
   a bucket, so what is shuffled is bounded by tasks and buckets.
2. The gains (one integer a bucket, BUCKETS in all whatever the input) go to the executors with the second pass, which
   gives each document its weight. The Gumbel noise comes from a hash of doc_id, so reruns agree.
3. The score at which the draw ends is found on counts per score. Only rows at or above it are ranked, by ranges of
   (score, doc_id): a range is a task's, and its first rank is the rows of all ranges before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm._tables import cut

BUCKETS, WORDS, SEED, LEAST_WORDS, PERCENT = 10_000, 2, 7, 20, 25
NEAR = 64
_POLYNOMIAL = 0xEDB88320
#: Bytes of words: digits, lower-case letters and all of multi-byte characters (A-Z are lower-cased before).
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _tables(matrix: np.ndarray) -> np.ndarray:
    """A matrix (the images of the 32 bits) as four tables of 256 entries."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            has = (np.arange(256) >> bit & 1).astype(bool)
            out[k][has] ^= matrix[8 * k + bit]
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 255]
    for k in range(1, 4):
        out = out ^ tables[k][crc >> np.uint32(8 * k) & 255]
    return out


@lru_cache(1)
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that shift a CRC by 0 to NEAR bytes ([n, part, byte]), and by 2^k bytes for each k."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    byte = bits.copy()
    for _ in range(8):  # one zero bit behind the message
        byte = (byte >> np.uint32(1)) ^ np.where(byte & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    step, now, near = _tables(byte), bits, []
    for _ in range(NEAR + 1):
        near.append(_tables(now))
        now = _apply(step, now)
    powers, now = [], byte
    for _ in range(40):
        powers.append(_tables(now))
        now = _apply(powers[-1], now)
    return np.stack(near), powers


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs of messages once n zero bytes stand behind them, but for the CRC of these bytes alone."""
    near, powers = _shifts()
    short = np.minimum(n, NEAR)
    flat = near.reshape(len(near), 4 * 256)
    out = flat[short, crc & 255]
    for k in range(1, 4):
        out = out ^ flat[short, 256 * k + (crc >> np.uint32(8 * k) & 255)]
    far = np.flatnonzero(n > NEAR)
    if len(far):
        some, left = crc[far], n[far]
        for k, table in enumerate(powers):
            has = left >> k & 1 == 1
            some[has] = _apply(table, some[has])
        out[far] = some
    return out


def combine(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32(A + B) of crc32(A), crc32(B) and the bytes of B."""
    return shift(first, n) ^ second


def word_crcs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and bytes of each word, and for each text the number of words before it (with the total). data: lower-cased."""
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.append([False], word[:-1])[: len(data)], np.append(word[1:], [False])[: len(data)]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # Stretches of words and of what lies between them, coded together: each distinct word is hashed once.
    bounds = np.unique(np.concatenate(([0], starts, ends, [len(data)]))).astype(np.int32)
    runs = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    words = runs.take(pa.array(np.searchsorted(bounds, starts))).dictionary_encode()
    known = np.fromiter(map(zlib.crc32, words.dictionary.to_pylist()), np.uint32, len(words.dictionary))
    return known[words.indices.to_numpy()], ends - starts, np.searchsorted(starts, offsets, "left")


def feature_buckets(data: np.ndarray, offsets: np.ndarray, most_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each feature (runs of 1 to most_words words of a text), and the words of each text."""
    crc, size, at = word_crcs(data, offsets)
    n_words = np.diff(at)
    text = np.repeat(np.arange(len(n_words)), n_words)
    spaced = combine(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, size)
    found, owners, gram, owner = [crc % buckets], [text], crc, text
    for n in range(2, most_words + 1):
        same = owner[: len(owner) - 1] == text[n - 1 :] if len(owner) > 1 else np.zeros(0, bool)
        gram = combine(gram[:-1], spaced[n - 1 :], size[n - 1 :] + 1)
        owner = owner[:-1]
        found.append(gram[same] % buckets)
        owners.append(owner[same])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), n_words


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    from postlode.llm._text import buffer, lowered, pieces

    for batch in pieces(batches, "text"):
        data, offsets = buffer(batch.column(batch.schema.get_field_index("text")))
        yield batch, lowered(data), offsets


def bucket_counts(texts: DataFrame, most_words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, count: features of all texts (text: null has none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in _lowered(batches):
            total += np.bincount(feature_buckets(data, offsets, most_words, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "count": pa.array(total[some], pa.int64())})

    return texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(docs: DataFrame, target: DataFrame, most_words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 * ln(share in the target / share in docs)), one added to each count."""
    sides = [bucket_counts(x, most_words, buckets).withColumn("side", F.lit(i)) for i, x in enumerate((docs, target))]
    both = np.zeros((2, buckets), np.int64)
    for row in sides[0].unionByName(sides[1]).collect():  # 2 * buckets rows at most
        both[row["side"], row["bucket"]] = row["count"]
    (own, aim), (all_own, all_aim) = both.astype(float), both.sum(1)
    return np.floor(1000 * np.log((aim + 1) * float(all_own + buckets) / ((own + 1) * float(all_aim + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most_words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The columns of docs but text, with n_words, n_features, weight, score (long); docs has a column text.

    weight is the floored mean of a text's gains (0 without features), score the weight and a Gumbel noise by doc_id.
    """
    names = [c for c in docs.columns if c != "text"]
    taken = {"n_words", "n_features", "weight", "score", "__hash"} & set(names)
    if taken:
        raise ValueError(f"docs has columns named {sorted(taken)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _lowered(batches):
            bucket, text, n_words = feature_buckets(data, offsets, most_words, len(gain))
            count = np.bincount(text, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, text, gain[bucket])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in [*names, "__hash"]]
            new = [pa.array(x, pa.int64()) for x in (n_words, count, total // np.maximum(count, 1))]
            yield pa.RecordBatch.from_arrays([*kept, *new], [*names, "__hash", "n_words", "n_features", "weight"])

    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__hash", hashed)
    fields = ", ".join(f"`{c.replace('`', '``')}` {rows.schema[c].dataType.simpleString()}" for c in [*names, "__hash"])
    noise = F.floor(-1000 * F.log(-F.log((F.col("__hash") + 0.5) / 4294967296)))
    return rows.mapInArrow(run, f"{fields}, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise).drop("__hash")


def last_score(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> tuple[int, int | None]:
    """How many rows are drawn, and the lowest score among them (None: none are drawn).

    Scores are thousandths of logarithms, so there are some ten thousands of them however many rows there are.
    """
    counts = scored.where(F.col("n_words") >= least_words).groupBy("score").count().orderBy(F.desc("score")).collect()
    draw = percent * sum(r["count"] for r in counts) // 100
    left = draw
    for row in counts:
        if left <= row["count"]:
            return draw, row["score"] if draw else None
        left -= row["count"]
    return draw, None


def _ranked(rows: DataFrame, draw: int) -> DataFrame:
    """rows with their rank by (score descending, doc_id), null above draw. Ranges of rows are tasks of their own."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    laid = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # A row's place in its partition is the low part of this id, the partition the high part.
    laid = cut(laid.withColumn("__place", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r[0], r[1]) for r in laid.groupBy(part.alias("part")).count().collect())  # a row a partition
    before, total = {}, 0
    for i, n in sizes:
        before[i] = total
        total += n
    first = F.lit(0).cast("long")
    if before:
        first = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])[part.cast("long")]
    rank = first + place + 1
    return laid.withColumn("rank", F.when(rank <= draw, rank)).drop("__place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, most_words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn), a row for each row of docs (doc_id, text).

    Of the N rows with at least least_words words floor(percent * N / 100) are drawn, by score, then doc_id, rows without
    a doc_id last; these share one noise, as do rows of one doc_id. Which of rows alike in both come first is open. Null
    and empty texts have no features and weight 0; texts are read whole, in pieces of half a MB of rows; an empty table
    gives no rows, an empty target gives gains that only docs decide. target: text. Other columns take no part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = cut(weigh(rows, gains(rows, target, most_words, buckets), most_words, seed), "scores")
    draw, last = last_score(scored, percent, least_words)
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(last)) if last is not None else F.lit(False)
    rest = scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return rest if last is None else _ranked(scored.where(drawn).select(*out), draw).unionByName(rest)


def draw_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options: int) -> DataFrame:
    """The rows of docs that resample() draws, with all their columns.

    doc_ids decide: rows that share a drawn doc_id and are drawn by resample() only in part come all.
    """
    chosen = resample(docs, target, percent, **options).where("rank is not null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
