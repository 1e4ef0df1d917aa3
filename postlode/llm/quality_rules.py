"""Weak supervision: quality rules vote or abstain, EM weighs them, the posterior decides.

Each rule of RULES looks at counts of one document and votes 1 (good), 0 (bad) or abstains. The label model takes a
rule's votes as right with an accuracy of its own, the same for both classes, and rules as independent given the
class. Documents with equal votes are alike to the model, so it is fitted on the counts of vote patterns: at most
3 ** len(RULES) rows, whatever the number of documents, summed by Spark over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlode.llm._tables import cut
from postlode.llm._text import buffer, pieces, spans, span_hashes, window_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_plain", "n_short", "n_stops", "n_same", "n_digit")
WINDOW = 5
#: Rule: bad at, good at, as shares of n_words (of n_lines for dup_lines). None: the rule never votes so.
#: Votes follow the side the bounds lie on: bad >= the first and good <= the second, or the reverse if the first is smaller.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.10, None),
    "shouting": ("n_upper", "n_words", 0.25, None),
    "odd_words": ("n_plain", "n_words", 0.80, 0.93),
    "short_words": ("n_short", "n_words", 0.08, 0.25),
    "sentences": ("n_stops", "n_words", 0.015, None),
    "stutter": ("n_same", "n_words", 0.06, None),
    "repeats": ("n_repeat_words", "n_words", 0.10, None),
    "dup_lines": ("n_dup_lines", "n_lines", 0.30, None),
}
PRIOR_GOOD, PRIOR_ACCURACY, PRIOR_WEIGHT, ROUNDS = 0.8, 0.9, 0.02, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LETTER = _UPPER | _LOWER
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_MARK = _STOP.copy()
_MARK[list(b",;:")] = True


def _sums(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[cuts[1:]] - total[cuts[:-1]]


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more, the first occurrence included."""
    if len(hashes) <= width:
        return 0
    windows = window_hashes(hashes, width)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    np.subtract.at(cover, at + width, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns COUNTS of each text; a null text counts as empty."""
    data, offsets = buffer(texts)
    starts, ends, words = spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n = len(offsets) - 1
    repeat, dup, lines = (np.zeros(n, np.int64) for _ in range(3))
    raw = data.tobytes()
    for i in range(n):
        repeat[i] = repeated_words(hashes[words[i] : words[i + 1]])
        own = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    width = ends - starts
    inner = np.zeros(len(data), bool)
    at = np.zeros(len(data) + 1, np.int64)
    np.add.at(at, starts, 1)
    np.add.at(at, ends, -1)
    inner[:] = np.cumsum(at[:-1]) > 0
    point = inner & ((data & 0xC0) != 0x80)
    each = np.stack((starts, ends), 1).ravel()
    inside = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int64), each)[::2] if len(each) else np.zeros(0, np.int64)
    letters, upper, lower = inside(_LETTER[data]), inside(_UPPER[data]), inside(_LOWER[data])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    plain = (letters >= 1) & (letters + _MARK[last] >= width)
    follows = np.append(False, hashes[1:] == hashes[:-1])[: len(hashes)]
    follows[words[:-1][words[:-1] < len(hashes)]] = False
    return {
        "n_words": np.diff(words),
        "word_chars": _sums(point, offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "n_lines": lines,
        "n_upper": _sums((upper >= 2) & (lower == 0), words),
        "n_plain": _sums(plain & ~((upper >= 2) & (lower == 0)), words),
        "n_short": _sums((width <= 3) & (lower == width), words),
        "n_stops": _sums(_STOP[last], words),
        "n_same": _sums(follows, words),
        "n_digit": _sums(inside(_DIGIT[data]) > 0, words),
    }


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the columns COUNTS (long); columns of these names give way to them."""
    keep = [c for c in docs.columns if c not in COUNTS and c != text]
    schema = docs.select(keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            found = counts(batch.column(batch.schema.get_field_index("__text")))
            own = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__text"]
            yield pa.RecordBatch.from_arrays(own + [pa.array(found[c], pa.int64()) for c in COUNTS], names=keep + list(COUNTS))

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def votes() -> F.Column:
    """One character a rule: g, b or - (abstains). A document without words has no votes."""
    out = []
    for count, total, bad, good in RULES.values():
        x = F.col(count) / F.greatest(F.col(total), F.lit(1))
        low_is_bad = count in ("n_plain", "n_short", "n_stops")
        case = F.when(F.col("n_words") == 0, F.lit("-")).when(x < bad if low_is_bad else x >= bad, F.lit("b"))
        if good is not None:
            case = case.when(x >= good if low_is_bad else x <= good, F.lit("g"))
        out.append(case.otherwise(F.lit("-")))
    return F.concat(*out)


def fit(patterns: list[tuple[str, int]]) -> tuple[float, np.ndarray]:
    """EM over (votes, number of documents): the share of good documents and each rule's accuracy.

    Every rule starts at PRIOR_ACCURACY and is held there by PRIOR_WEIGHT of all documents as pseudo-votes, so that a
    rule that hardly votes, or an empty table, still gives a model.
    """
    patterns = sorted(patterns)
    n = np.array([c for _, c in patterns], float)
    vote = np.array([[{"g": 1, "b": -1, "-": 0}[v] for v in p] for p, _ in patterns], float).reshape(len(patterns), len(RULES))
    share, accuracy = PRIOR_GOOD, np.full(len(RULES), PRIOR_ACCURACY)
    hold = PRIOR_WEIGHT * max(1.0, n.sum())
    for _ in range(ROUNDS if len(patterns) else 0):
        good = posterior(vote, share, accuracy)
        right = (n * good) @ (vote > 0) + (n * (1 - good)) @ (vote < 0)
        cast = n @ (vote != 0)
        accuracy = np.clip((right + hold * PRIOR_ACCURACY) / (cast + hold), 0.55, 0.99)
        share = float(np.clip((n @ good + hold * PRIOR_GOOD) / (n.sum() + hold), 0.05, 0.95))
    return share, accuracy


def posterior(vote: np.ndarray, share: float, accuracy: np.ndarray) -> np.ndarray:
    weight = np.log(accuracy / (1 - accuracy))
    return 1 / (1 + np.exp(-(np.log(share / (1 - share)) + vote @ weight)))


def judge(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality (the posterior of good) and kept to a frame with the columns COUNTS."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    voted = counted.withColumn("base_failed", base).withColumn("votes", votes())
    # At most 3 ** len(RULES) rows reach the driver, by construction.
    patterns = [(r[0], r[1]) for r in voted.groupBy("votes").count().collect()]
    share, accuracy = fit(patterns)
    score = F.lit(float(np.log(share / (1 - share))))
    for i, a in enumerate(accuracy):
        weight = float(np.log(a / (1 - a)))
        score = score + F.when(F.substring("votes", i + 1, 1) == "g", weight).when(F.substring("votes", i + 1, 1) == "b", -weight).otherwise(0.0)
    quality = 1 / (1 + F.exp(-score))
    return voted.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a document: its columns but the text, COUNTS, votes, base_failed, quality, kept.

    Null, empty and blank texts have no words and fail the base rule. Repeated rows are judged each; an empty table
    gives an empty result. Counted once: the counts are written before the model is fitted, and judged from there.
    """
    return judge(cut(with_counts(docs), "quality-counts"), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that pass, whole and with their own columns; equal texts get equal verdicts.

    The verdict is a function of one document and of the model, so the second pass needs no join: it counts again.
    """
    model = judge(cut(with_counts(docs.select("text")), "quality-counts"), threshold)
    bad = [r[0] for r in model.where(~F.col("kept") & ~F.col("base_failed")).select("votes").distinct().collect()]
    schema = StructType(list(docs.schema.fields))
    for c in COUNTS:
        schema = schema.add(f"__{c}", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = counts(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=[*batch.schema.names, *(f"__{c}" for c in COUNTS)])

    counted = docs.mapInArrow(run, schema)
    held = counted.select(F.struct(*docs.columns).alias("doc"), *(F.col(f"__{c}").alias(c) for c in COUNTS))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return held.where(~base & ~votes().isin(bad) if bad else ~base).select("doc.*")
