"""Fill-in-the-middle transformation: documents as prefix, suffix and middle, cut between tokens.

Tokens are runs of ASCII letters, and every other character alone. Whether a token begins at a character depends on that
character and the one before it only. Texts are taken as chunks that overlap by one character: the predicate over
adjacent characters counts the beginnings in all chunks of a task's rows at once, prefix sums of the counts tell which
chunk owns a cut's rank, and only the chunks that own one are scanned again for its place. Counts of characters follow
the same way. Cuts and form come from a hash of doc_id, so reruns agree; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4_096
PIECE_BYTES = 1_000_000
SEED, PERCENT_FIM, PERCENT_SPM = 1, 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def begins(data: np.ndarray, before: int = 0) -> np.ndarray:
    """Whether a token begins at each byte of UTF-8; before: the byte in front of data (0: a text's start)."""
    letter = _LETTER[data]
    inside = np.empty(len(data), bool)
    inside[:1] = _LETTER[before]
    inside[1:] = letter[:-1]
    return ((data & 0xC0) != 0x80) & ~(letter & inside)


class Chunks:
    """Beginnings of tokens and of characters in texts that lie one behind the other, counted by chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = CHUNK):
        self.data, self.offsets = data, offsets
        count = -(-np.diff(offsets) // size)
        self.first = np.append(0, np.cumsum(count))
        text = np.repeat(np.arange(len(count)), count)
        self.starts = np.append(offsets[text] + (np.arange(len(text)) - self.first[text]) * size, len(data))
        starts = self.starts[:-1]
        found = begins(data)
        found[offsets[:-1][count > 0]] = True  # nothing stands before a text's first character
        add = lambda x: np.append(0, np.cumsum(np.add.reduceat(x, starts, dtype=np.int64))) if len(starts) else np.zeros(1, np.int64)
        self.tokens, self.chars = add(found), add((data & 0xC0) != 0x80)

    def n_tokens(self) -> np.ndarray:
        return self.tokens[self.first[1:]] - self.tokens[self.first[:-1]]

    def cut(self, text: int, rank: int) -> tuple[int, int]:
        """Bytes and characters of a text before its token of this rank (from 0; the number of tokens: the text's end)."""
        a, b = self.first[text], self.first[text + 1]
        at, left = self.offsets[text], self.tokens[a] + rank
        if left >= self.tokens[b]:
            return int(self.offsets[text + 1] - at), int(self.chars[b] - self.chars[a])
        chunk = int(np.searchsorted(self.tokens[a : b + 1], left, "right")) - 1 + int(a)
        start = self.starts[chunk]
        piece = self.data[start : self.starts[chunk + 1]]
        places = np.flatnonzero(begins(piece, int(self.data[start - 1]) if start > at else 0))
        place = int(places[left - self.tokens[chunk]])
        return int(start + place - at), int(self.chars[chunk] - self.chars[a] + ((piece[:place] & 0xC0) != 0x80).sum())


def transform(docs: DataFrame, seed: int = SEED, percent_fim: int = PERCENT_FIM, percent_spm: int = PERCENT_SPM, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: a row for each row of docs (doc_id, text).

    With h1 to h4 the first four groups of 8 hex digits of sha256("seed:doc_id"), the cuts lie after the smaller and the
    larger of h1 % (n + 1) and h2 % (n + 1) tokens. The form is plain where a text is empty or null, holds a marker, or
    h3 % 100 >= percent_fim; else spm (suffix first) where h4 % 100 < percent_spm, else psm. Rows without a doc_id hash
    the seed and the colon alone; repeated rows give repeated results; texts of any length are read whole, at about ten
    bytes of memory a byte; other columns take no part.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from postlode.llm._text import buffer, pieces

        for batch in pieces(batches, "text", PIECE_BYTES):
            data, offsets = buffer(batch.column("text"))
            raw = data.tobytes()
            chunks = Chunks(data, offsets, chunk)
            n, rows = chunks.n_tokens(), []
            for i, h in enumerate(zip(*(batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)), strict=True)):
                text = raw[offsets[i] : offsets[i + 1]]
                if not text or any(m in text for m in marks) or h[2] % 100 >= percent_fim:
                    rows.append(("plain", None, None, text))
                    continue
                low, high = sorted((h[0] % (int(n[i]) + 1), h[1] % (int(n[i]) + 1)))
                (a, a_chars), (b, b_chars) = chunks.cut(i, low), chunks.cut(i, high)
                spm = h[3] % 100 < percent_spm
                parts = (marks[1], text[b:], marks[0], text[:a], marks[2]) if spm else (marks[0], text[:a], marks[1], text[b:], marks[2])
                rows.append(("spm" if spm else "psm", a_chars, b_chars - a_chars, b"".join((*parts, text[a:b]))))
            form, prefix, middle, output = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(n, pa.int64()),
                    "form": pa.array(form, pa.string()),
                    "prefix_chars": pa.array(prefix, pa.int64()),
                    "middle_chars": pa.array(middle, pa.int64()),
                    "output": pa.array(output, pa.binary()).cast(pa.string()),
                }
            )

    doc_id = F.col("doc_id").cast("long")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    hashes = [F.conv(F.substring("key", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return rows.select("doc_id", "text", *hashes).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text that transform() made an output of. A marker stands once in an output that is not plain."""
    parts = F.split(output, "<[PSM]>", -1)
    order = F.when(form == "psm", F.array(F.lit(1), F.lit(3), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3), F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.array_join(F.transform(order, lambda i: F.get(parts, i)), ""))


def digest(docs: DataFrame) -> DataFrame:
    """transform() with hashes of its outputs and of the texts restored from them."""
    out = transform(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: DuckDB SQL over documents.
ORACLE_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
tokens AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
    list_transform([1, 9, 17, 25], lambda k: CAST(('0x' || substr(key, k, 8)) AS BIGINT)) AS h FROM hashed),
cuts AS (
  SELECT *, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS low, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM tokens),
parts AS (
  SELECT *, array_to_string(tokens[1:low], '') AS prefix, array_to_string(tokens[low + 1:high], '') AS middle, array_to_string(tokens[high + 1:], '') AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""
