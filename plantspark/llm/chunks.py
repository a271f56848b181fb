"""Runs of rows of a few megabytes of text, compressed: what one step of a task works on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20


def pack(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``chunk, body``: runs of rows of about ``chunk_bytes`` of text as compressed Arrow data. Needs no shuffle."""
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def body() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + seq]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "body"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()
            start = 0
            for i, n in enumerate(lengths):
                size += int(n)
                if size >= chunk_bytes:
                    held.append(batch.slice(start, i + 1 - start))
                    yield body()
                    start, held, size, seq = i + 1, [], 0, seq + 1
            if start < len(batch):
                held.append(batch.slice(start))
        if held:
            yield body()

    return docs.mapInArrow(scan, "chunk long, body binary")


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers with their bytes sorted by rank, compressed."""
    numbers = np.ascontiguousarray(numbers)
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes(), "zstd", asbytes=True)


def restore(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(kind)


def cuts_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of 64-bit codes begins in the sorted codes, and their end."""
    edges = [(k << 64) // parts for k in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(codes, np.array(edges, np.uint64)), [len(codes)]]).astype(np.int64)


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
