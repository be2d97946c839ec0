"""Corpus chunks and hash exchanges shared by the operators that compare all texts.

``chunk_table`` packs whole texts into rows of a few megabytes (compressed), written
as a stage table; a chunk is the unit of recovery and of memory. ``exchange`` sends
what each chunk knows about its hashes to reducers by hash range and brings an answer
back to each chunk. A chunk sends a hash once, however often it occurs, so a hot hash
reaches its reducer at most once a chunk.

At 100 TB raise ``chunk_bytes`` to 64 MB: message counts are chunks x buckets, and each
message then still holds some dozens of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import enter
from .stage import ship, stage

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20  # text a reducer stands for


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(data))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned values as differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype)).astype("<u8")
    return len(values).to_bytes(8, "little") + pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(unpack(data[8:]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel())


def texts_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.large_binary()).to_pylist()]


def chunk_table(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Stage table (chunk_id, ids, lens, blob): the documents' ids, the byte lengths of
    their texts, and the texts. A longer text is a chunk of its own."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("chunks")
        task, seq = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([
                pa.array([(task << 32) | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([pack(b"".join(texts))], pa.binary())], names=["chunk_id", "ids", "lens", "blob"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                if texts and size + len(t) > chunk_bytes:
                    yield row()
                    seq, ids, texts, size = seq + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield row()

    ship(docs.sparkSession)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(cols.mapInArrow(cut, "chunk_id long, ids array<long>, lens array<long>, blob binary"), "chunks")


def chunk_texts(lens, blob) -> list[bytes]:
    data, out, at = unpack(blob), [], 0
    for n in lens:
        out.append(data[at:at + n])
        at += n
    return out


def bucket_count(chunks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    total = chunks.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return max(8, int(-(-total // bucket_bytes)))


def slices(values: np.ndarray, n_buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's part of ascending ``bits``-bit values starts (one more: the end)."""
    edges = [-(-(b << bits) // n_buckets) for b in range(n_buckets)]
    return np.concatenate((np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]))


def exchange(rows: DataFrame, emit: Callable[[dict], Iterator[tuple[int, bytes]]],
             reduce: Callable[[list[bytes]], list[bytes]], name: str) -> DataFrame:
    """Stage table (chunk_id, <name>: array<struct<bucket, data>>).

    ``emit(row)`` gives (bucket, message) pairs of a chunk's row; ``reduce(messages)``
    answers each message of a bucket."""
    columns = rows.columns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("chunks")
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in columns}
                out = list(emit(row))
                if out:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([b for b, _ in out], pa.int32()), pa.array([row["chunk_id"]] * len(out), pa.int64()),
                        pa.array([m for _, m in out], pa.binary())], names=["bucket", "chunk_id", "data"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        enter("chunks")
        return pd.DataFrame({"chunk_id": group["chunk_id"], "bucket": group["bucket"],
                             "data": reduce([bytes(m) for m in group["data"]])})

    sent = rows.mapInArrow(send, "bucket int, chunk_id long, data binary")
    answers = sent.groupBy("bucket").applyInPandas(answer, "chunk_id long, bucket int, data binary")
    # one chunk's answers: a short message for each bucket
    return stage(answers.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "data"))).alias(name)), name)


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    return rows.join(answers, "chunk_id", "left")


def per_row(fn: Callable[[dict], Iterator[tuple]], columns: list[str], schema: pa.Schema):
    """mapInArrow function: each chunk row gives a batch of rows from ``fn``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("chunks")
        for batch in batches:
            for i in range(batch.num_rows):
                out = list(fn({c: batch.column(c)[i].as_py() for c in columns}))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, f.type) for col, f in zip(zip(*out), schema)] if out
                    else [pa.array([], f.type) for f in schema], schema=schema)
    return run
