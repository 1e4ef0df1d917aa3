"""SentencePiece encoding that keeps offsets, and decoding.

Each task normalises and encodes the texts of its rows through the model's compiled character map (piece_model) and
gives, for every id, the bytes of the original text it stands for: text.encode()[start:end]. Byte pieces of one
character share its start and only the last of them covers it, and the blank that the model puts before a text covers
nothing. There is no shuffle; a task keeps one encoder with a cache of chunks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 500_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, model: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids, starts, ends (arrays of int, one entry an id), a row for each row of docs (doc_id, text).

    decoded: also the column decoded, the text of ids, made by the worker that has the model in memory already.

    Null and empty texts have no ids. Rows without a doc_id and repeated rows are encoded like all others; other columns
    take no part. A text is read whole; a task holds about 40 bytes for each of its bytes, and the rows of a batch are
    taken PIECE_BYTES of text at a time.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from postlode.llm._text import pieces
        from postlode.llm.piece_model import pieces_of

        encoder = pieces_of(model)
        for batch in pieces(batches, "text", PIECE_BYTES):
            ids, at, starts, ends = encoder.encode_spans(batch.column("text"))
            made = {"doc_id": batch.column("doc_id"), "ids": _lists(ids, at), "starts": _lists(starts, at), "ends": _lists(ends, at)}
            if decoded:
                made["decoded"] = pa.array([encoder.decode(ids[a:b]) for a, b in itertools.pairwise(at.tolist())], pa.string())
            yield pa.RecordBatch.from_pydict(made)
            del ids, at, starts, ends, made
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The columns of encoded (ids among them) and decoded, the text of ids; null ids give null. A column named decoded is an error."""
    model = model or default_model()
    if "decoded" in encoded.columns:
        raise ValueError("there is a column named decoded already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from postlode.llm.piece_model import pieces_of

        encoder = pieces_of(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                column = part.column(part.schema.get_field_index("ids"))
                values = column.values.to_numpy(zero_copy_only=False)
                at = column.offsets.to_numpy()
                texts = [encoder.decode(values[a:b]) if ok else None for (a, b), ok in zip(itertools.pairwise(at.tolist()), column.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and span_bytes: bytes of the text that the ids' spans cover."""
    both = encode(docs, model, decoded=True)
    covered = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        covered.alias("span_bytes"),
    )
