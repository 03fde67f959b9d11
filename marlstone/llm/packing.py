"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups.

Each document becomes its ids and an end id, cut into pieces of at most one
sequence.  Pieces are dealt into groups by a hash, and each group is packed
alone: pieces in descending length, each into the first bin with room, which a
tournament tree over the bins' room finds in logarithmic time.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import default_path
from .common import bounded_batches, materialise, table
from .word_ids import text_ids

LENGTH, END_ID = 4096, 2
GROUP = 8192  # pieces of a group, about


class Bins:
    """Room of bins under a tournament tree; each inner node holds the larger room of its two."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.size, self.used = capacity, 1, 0
        while self.size < max(1, most):
            self.size *= 2
        self.room = [capacity] * (2 * self.size)

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) of the first bin with room for n."""
        at, room, size = 1, self.room, self.size
        while at < size:
            at *= 2
            if room[at] < n:
                at += 1
        offset = self.capacity - room[at]
        room[at] -= n
        out = at - size
        self.used = max(self.used, out + 1)
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return out, offset


def first_fit_decreasing(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) for each length, in the order given; ties keep their order."""
    bins, out = Bins(capacity, len(lengths)), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = bins.place(lengths[i])
    return out


def token_bytes(text: str | None, path: str, end_id: int | None = END_ID) -> bytes:
    """Little-endian unsigned 32-bit ids of a text, then end_id."""
    (ids,) = text_ids(path).of([(text or "").encode()])
    return ids.astype("<u4").tobytes() + (b"" if end_id is None else struct.pack("<I", end_id))


PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long, doc_tokens long"


def document_pieces(docs: DataFrame, path: str | None = None, capacity: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids for each row of docs (doc_id, text); with_ids adds the ids themselves."""
    path, id_type = path or default_path(), docs.schema["doc_id"].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
            rows, ids = [], []
            for k, own in enumerate(text_ids(path).of(texts)):
                raw = memoryview(own.astype("<u4", copy=False).tobytes() + end)
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((k, n, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4))
                    if with_ids:
                        ids.append(bytes(part))
            k, *cols = list(zip(*rows)) if rows else [[]] * 6
            out = [b.column("doc_id").take(pa.array(k, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, [pa.int32(), *[pa.int64()] * 4])]] + [pa.array(ids, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, PIECES.format(id_type) + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str | None = None, capacity: int = LENGTH, end_id: int = END_ID, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every id of every row of docs lies in exactly one piece.  A null or empty
    text is its end id alone; a repeated row is packed again; a null doc_id is
    packed like any other.  Texts over one sequence fill sequences and leave a
    rest.  Extra columns are ignored; an empty table gives no rows.  The number
    of groups follows the number of pieces, so a group stays bounded.
    """
    # the salt is stored with the pieces, so a task run again deals them alike
    pieces = materialise(document_pieces(docs, path, capacity, end_id, with_ids).withColumn("salt", F.monotonically_increasing_id()), "packing-pieces")
    groups = max(1, round(pieces.count() / group))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("length", "descending"), ("ids_crc32", "ascending"), ("start", "ascending"), ("salt", "ascending")]))
        placed = first_fit_decreasing(t["length"].to_pylist(), capacity)
        at = {"sequence_id": [(key[0].as_py() << 32) + b for b, _ in placed], "offset": [o for _, o in placed]}
        t = t.drop_columns(["g", "piece", "salt"])
        for c, v in at.items():
            t = t.append_column(c, pa.array(v, pa.int64()))
        return t

    # a long text's pieces spread over groups, and so do rows of one doc_id or none, so that no group grows with them
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(
        run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    )


def packed_sequences(docs: DataFrame, **how) -> DataFrame:
    """sequence_id, ids_bytes (little-endian unsigned 32-bit ids, unpadded) and n_ids: the sequences themselves.

    Rows of docs with null or empty texts bring their end id; an empty table
    gives no sequences; nulls, repeats and extra columns are as for pack.
    """
    parts = pack(docs, with_ids=True, **how)
    return parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids_bytes")
    ).withColumn("n_ids", F.octet_length("ids_bytes") / 4)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
