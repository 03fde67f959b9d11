"""Blocks of documents, and arrays as compressed cells.

Operators that ask the whole corpus about millions of small keys work on blocks
of documents: a block's distinct keys go out as one cell for each partition of
keys, are answered there, and the answers come back as one cell each. The
shuffles then carry packed arrays, and a hot key costs one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

BLOCK_BYTES = 2 << 20  # text of a block, about; one longer document is a block of its own


def squeeze(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def unsqueeze(b: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(bytes(b))
    return raw if kind is None else np.frombuffer(raw, kind)


def thin(a: np.ndarray, n: int) -> bytes:
    """The low n bytes of each unsigned 64-bit number."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def thick(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def dealt(parts: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part, and the count + 1 borders of the parts in it."""
    order = np.argsort(parts.astype(np.uint16 if count < 1 << 16 else np.uint32), kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(parts.astype(np.int64), minlength=count))))


def arrow_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[str, bytes, list[bytes]]]:
    """(block name, the rows' other columns as Arrow IPC bytes, texts as UTF-8 bytes); null counts as empty."""
    from pyspark import TaskContext

    part, n, size = TaskContext.get().partitionId(), 0, 0
    slices: list[pa.RecordBatch] = []
    texts: list[bytes] = []

    def packed():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, slices[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for s in slices:
                w.write_batch(s)
        return sink.getvalue().to_pybytes()

    for b in batches:
        others, start = b.drop_columns([column]), 0
        for i, x in enumerate(b.column(column)):
            t = (x.as_py() or "").encode("utf-8", "surrogatepass")
            if texts and size + len(t) > limit:
                if i > start:
                    slices.append(others.slice(start, i - start))
                yield f"{part}-{n}", packed(), texts
                n, size, texts, slices, start = n + 1, 0, [], [], i
            texts.append(t)
            size += len(t)
        if b.num_rows > start:
            slices.append(others.slice(start))
    if texts:
        yield f"{part}-{n}", packed(), texts


def rows_of(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def spark_hash(numbers: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur3, seed 42) of 64-bit numbers, by which it deals rows and buckets."""
    v = numbers.astype(np.uint64)

    def turned(x, r):
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    h = np.full(len(v), 42, np.uint32)
    for half in ((v & np.uint64(0xFFFFFFFF)).astype(np.uint32), (v >> np.uint64(32)).astype(np.uint32)):
        h ^= turned(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def numbers_in_bucket(part: int, buckets: int) -> Iterator[int]:
    """Numbers that no other partition gives, all in bucket part % buckets of Spark's bucketing."""
    at = part << 32
    while True:
        tried = np.arange(at, at + 4 * buckets + 64)
        yield from tried[spark_hash(tried) % np.int32(buckets) == part % buckets].tolist()
        at += len(tried)


def buckets_of(parts: int) -> int:
    return min(parts, 100_000)  # more buckets than these Spark refuses
