"""Token ids as compressed binary shards with random access to any document.

A shard is one file:

    "PLTOKEN1"  8 bytes
    sha256 of the dictionary  32 bytes
    a zstandard frame for each document, one behind the other, made with the shared dictionary
    the index: for each document doc_id int64, offset of its frame uint64, n_ids uint64 (little-endian)
    number of documents uint64, of these without doc_id (the first ones, 0 in the index) uint64, offset of the index uint64

A frame holds the document's ids, the end id included, as little-endian unsigned 16-bit integers. The dictionary is a
file beside the shards, named by its hash. Documents lie in ascending doc_id order, null first, within a shard and shards
cover ascending ranges, so ids before a document are the shards' totals before it and the index entries before it.

Each task attempt writes a file of a new name and returns a row about it; readers open only files that such a row in
the manifest names. What a lost executor or a second attempt left behind is never read.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlode.llm._tables import new_path

MAGIC, END_ID = b"PLTOKEN1", 0
DICT_DOCS, DICT_CHARS, DICT_BYTES, LEVEL = 2_000, 8_000, 64 * 1024, 3
ROWS_PER_SHARD = 16_000
MANIFEST = "shard int, path string, n_docs long, n_ids long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _encoder(vocabulary: str):
    from postlode.llm._tokens import encoder

    return encoder(vocabulary, spaces=True)


def train_dictionary(docs: DataFrame, vocabulary: str) -> bytes:
    """A dictionary from the id arrays of DICT_DOCS documents, by hash of doc_id; of a longer one, its first DICT_CHARS characters.

    Empty bytes where there are too few ids to train on: frames are then made without a dictionary.
    """
    import zstandard

    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICT_DOCS)
    some = docs.join(F.broadcast(chosen), "doc_id").select(F.substring("text", 1, DICT_CHARS).alias("text")).orderBy(F.xxhash64("text")).limit(DICT_DOCS)
    ids, at = _encoder(vocabulary).encode(pa.array([r[0] for r in some.collect()], pa.string()))
    try:
        return zstandard.train_dictionary(DICT_BYTES, [ids[a:b].tobytes() for a, b in itertools.pairwise(at) if b > a]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _write_shards(folder: str, vocabulary: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        from postlode.llm._text import pieces
        from postlode.llm._tokens import PIECE_BYTES

        encoder, shard = _encoder(vocabulary), TaskContext.get().partitionId()
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        fs, base = _open(folder)
        path, out, at, index, total = f"{base}/{shard:06d}-{uuid.uuid4().hex}.bin", None, 40, [], 0
        nulls = 0
        end = struct.pack("<H", END_ID)
        for batch in pieces(batches, "text", PIECE_BYTES):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(path, compression=None)
                out.write(MAGIC + hashlib.sha256(dictionary).digest())
            ids, bounds = encoder.encode(batch.column("text"))
            for doc_id, (first, last) in zip(batch.column("doc_id").to_pylist(), itertools.pairwise(bounds.tolist()), strict=True):
                frame = packer.compress(ids[first:last].tobytes() + end)
                out.write(frame)
                index.append((doc_id or 0, at, last - first + 1))
                nulls += doc_id is None
                at += len(frame)
                total += index[-1][2]
        if out is not None:
            table = np.array(index, np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_ids", "<u8")]))
            out.write(table.tobytes() + struct.pack("<QQQ", len(index), nulls, at))
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(index)], "n_ids": [total]})

    return run


def write_store(docs: DataFrame, folder: str, vocabulary: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) into folder; returns the manifest (shard, path, n_docs, n_ids), also kept there.

    Null and empty texts give the end id alone; repeated doc_ids lie side by side, ordered by text; rows without a
    doc_id come before all others, and only their place can look them up. Other columns take no part.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, vocabulary)
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{hashlib.sha256(dictionary).hexdigest()}.dict", compression=None) as out:
        out.write(dictionary)
    # Bounds from doc_id alone: sampling the texts themselves for a range partitioning would read them twice.
    count = docs.select("doc_id").count() if shards is None else 0
    shards = shards or max(1, -(-count // ROWS_PER_SHARD), min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    laid = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "text")
    laid.mapInArrow(_write_shards(folder, vocabulary, dictionary), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _fetch(folder: str, dictionary_hash: bytes) -> bytes:
    fs, base = _open(folder)
    with fs.open_input_stream(f"{base}/{dictionary_hash.hex()}.dict", compression=None) as f:
        found = f.read()
    if hashlib.sha256(found).digest() != dictionary_hash:
        raise ValueError("the dictionary is not the one the shard was written with")
    return found


class Shard:
    """Random access to one shard: ids(doc_id) reads that document's frame only."""

    def __init__(self, folder: str, path: str):
        import zstandard

        fs, _ = _open(folder)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        size = self.file.size()
        n, self.nulls, self.end = struct.unpack("<QQQ", self.file.read_at(24, size - 24))
        self.index = np.frombuffer(self.file.read_at(24 * n, self.end), np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_ids", "<u8")]))
        dictionary = _fetch(folder, head[8:])
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def at(self, i: int) -> np.ndarray:
        first = int(self.index["offset"][i])
        last = int(self.index["offset"][i + 1]) if i + 1 < len(self.index) else self.end
        return np.frombuffer(self.unpacker.decompress(self.file.read_at(last - first, first)), "<u2")

    def ids(self, doc_id: int) -> np.ndarray:
        i = self.nulls + int(np.searchsorted(self.index["doc_id"][self.nulls :], doc_id))
        if i == len(self.index) or self.index["doc_id"][i] != doc_id:
            raise KeyError(doc_id)
        return self.at(i)

    def close(self) -> None:
        self.file.close()


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, read from the shards: doc_id, start (ids of all documents before it), ids (binary, uint16)."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    # One row a shard, so a single task orders them.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("before", before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shard = Shard(folder, path)
                starts = at + np.concatenate(([0], np.cumsum(shard.index["n_ids"].astype(np.int64))))
                n = len(shard.index)
                for first in range(0, n, 512):
                    rows = range(first, min(n, first + 512))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.index["doc_id"][first : rows.stop], mask=np.arange(first, rows.stop) < shard.nulls), "start": pa.array(starts[first : rows.stop]), "ids": pa.array([shard.at(i).tobytes() for i in rows], pa.binary())})
                shard.close()

    # A shard a task: the manifest is a few rows, the work behind each is not.
    spread = shards.repartition(int(max(1, manifest.count())), "shard")
    return spread.select("path", "before").mapInArrow(run, "doc_id long, start long, ids binary")


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def digest(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a frame from read_store()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([crc32_of(x) for x in ids], pa.int64())})

    return store.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None) -> DataFrame:
    folder = folder or new_path(docs.sparkSession, "tokens")
    write_store(docs, folder, vocabulary)
    return digest(read_store(docs.sparkSession, folder))
