"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Words are runs of letters, runs of digits (all alike) and runs of other marks. Features are words and pairs of
neighbouring words, each as it is and by its shape (upper, lower, capitalised, mixed letters; marks by their
characters), hashed into 2 ** BITS weights; a pair of equal words has a feature of its own. Values are counts over the
square root of the document's number of words. Scoring is a sparse dot product: the weights go to the executors as one
broadcast array of 2 ** BITS floats, a bound that the data doesn't change.

Training reads MOST_ROWS labelled documents at most, those of the smallest hashes of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm._text import buffer, mix, pieces, span_hashes

BITS, MOST_ROWS, EPOCHS = 18, 8_192, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_CLASS = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 mark
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2
_UP = np.zeros(256, bool)
_UP[65:91] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts behind each other, where each text's begin (with the end), and its words."""
    data, offsets = buffer(texts)
    n = len(offsets) - 1
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    turn = np.append(True, kind[1:] != kind[:-1])[: len(data)] | edge[:-1]
    starts = np.flatnonzero(turn & (kind > 0))
    last = np.append(turn[1:], True)[: len(data)]
    ends = np.flatnonzero(last & (kind > 0)) + 1
    words = np.searchsorted(starts, offsets, "left")
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    own = kind[starts]
    word = span_hashes(data, starts, ends)
    word[own == 2] = np.uint64(7)
    upper = np.concatenate(([0], np.cumsum(_UP[data])))
    ups, first = upper[ends] - upper[starts], _UP[data[starts]]
    size = ends - starts
    shape = np.where(ups == 0, 1, np.where((ups == size) & (size > 1), 2, np.where((ups == 1) & first, 3, 4))).astype(np.uint64)
    shape = np.where(own == 1, shape + np.uint64(4) * (size <= 3).astype(np.uint64), np.where(own == 2, np.uint64(9), word))
    pair = np.ones(len(starts), bool)
    pair[words[1:-1][words[1:-1] < len(starts)]] = False
    pair[0] = False
    left_word, left_shape = np.roll(word, 1), np.roll(shape, 1)
    two = mix(left_word * np.uint64(3) + word * np.uint64(5))
    two[left_word == word] = np.uint64(11)
    columns = (mix(word + np.uint64(1)), mix(shape * np.uint64(31) + np.uint64(2)), two, mix(left_shape * np.uint64(1_000_003) + shape * np.uint64(17) + np.uint64(3)))
    table = np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in columns], 1)
    mask = np.ones(table.shape, bool)
    mask[~pair, 2:] = False
    before = np.concatenate(([0], np.cumsum(mask.sum(1))))
    return table[mask], before[words], np.diff(words)


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    """FTRL-proximal over rows of (features, counts, norm, label), in a fixed order."""
    rows = rows.sort_values(["place", "doc_id"])
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    data = [(np.frombuffer(f, "<i4"), np.frombuffer(c, "<f4").astype(float), y) for f, c, y in zip(rows["features"], rows["values"], rows["label"], strict=True)]
    for _ in range(EPOCHS):
        for i, x, y in data:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    every = np.arange(1 << BITS)
    w = weights(every)
    return pd.DataFrame({"feature": every[w != 0].astype(np.int32), "weight": w[w != 0].astype(np.float32)})


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found, at, words = features(batch.column("text"))
        fs, vs = [], []
        for a, b, k in zip(at, at[1:], words, strict=False):
            f, c = np.unique(found[a:b], return_counts=True)
            fs.append(f.astype("<i4").tobytes())
            vs.append((c / np.sqrt(max(1, k))).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "place": batch.column("place"), "label": batch.column("label"), "features": pa.array(fs, pa.binary()), "values": pa.array(vs, pa.binary())})


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> np.ndarray:
    """Weights of all features. labels: doc_id, quality (0 or 1; others and nulls are left out).

    A doc_id with both labels teaches nothing. Of rows that share a doc_id the one of the smallest text hash teaches,
    so most_rows bounds the rows of the training task and its order has no ties. Without labels all weights are 0 and
    every score is 0.5. A text of any length is read whole.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    chosen = each.select("doc_id", "label", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    shape = "doc_id long, place long, label int, features binary, values binary"
    texts = rows.select("doc_id", "place", "label", F.coalesce("text", F.lit("")).alias("text"))
    once = texts.groupBy("doc_id", "place", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    sparse = once.select("doc_id", "place", "label", "row.text").mapInArrow(_with_features, shape)
    # One task: the updates are a sequence, and the rows are bounded by most_rows.
    learnt = sparse.groupBy(F.lit(0).alias("all")).applyInPandas(_learn, "feature int, weight float").toPandas()
    out = np.zeros(1 << BITS, np.float32)
    out[learnt["feature"].to_numpy()] = learnt["weight"].to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts get the score of no features, 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, at, words = features(batch.column("text"))
            total = np.concatenate(([0.0], np.cumsum(sent.value[found], dtype=np.float64)))
            logit = (total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(words, 1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Repeated rows are scored each and alike, equal texts get equal scores, a null doc_id is not held out; columns other
    than doc_id and text take no part. An empty table gives an empty result.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
