"""Bloom filters as values: bits as bytes, set and tested by a chain of SipHash-1-3 values.

The first hash of a key is under the zero key; each further one is of the empty
message under the key (0, the hash before).  Eight keys' bits share a byte, most
significant bit first, and 64 bits a word while a filter is put together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .values import col

#: Bits of a filter that travels as one value.
MOST_BITS = 1 << 31
_INIT = tuple(np.uint64(x) for x in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573))


def _turned(x, n):
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(v0, v1, v2, v3):
    v0 = v0 + v1
    v1 = _turned(v1, 13) ^ v0
    v0 = _turned(v0, 32)
    v2 = v2 + v3
    v3 = _turned(v3, 16) ^ v2
    v0 = v0 + v3
    v3 = _turned(v3, 21) ^ v0
    v2 = v2 + v1
    v1 = _turned(v1, 17) ^ v2
    return v0, v1, _turned(v2, 32), v3


def siphash13(words: np.ndarray, k0, k1) -> np.ndarray:
    """SipHash-1-3 of many messages at once, given as rows of 64-bit words whose last one holds the length and the rest."""
    n = len(words)
    k0, k1 = (np.broadcast_to(np.asarray(k, np.uint64), n) for k in (k0, k1))
    v = [k ^ i for k, i in zip((k0, k1, k0, k1), _INIT)]
    for c in range(words.shape[1]):
        v[3] = v[3] ^ words[:, c]
        v = list(_round(*v))
        v[0] = v[0] ^ words[:, c]
    v[2] = v[2] ^ np.uint64(0xFF)
    for _ in range(3):
        v = list(_round(*v))
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def message_words(messages: list[bytes]) -> np.ndarray:
    """Rows of words of messages of one length."""
    n = len(messages[0])
    padded = b"".join(m + b"\0" * (7 - n % 8) + bytes([n & 255]) for m in messages)
    return np.frombuffer(padded, "<u8").reshape(len(messages), -1)


def positions(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """The places of each key's bits, a row for each key."""
    out = np.zeros((len(keys), hashes), np.int64)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_length.setdefault(len(k), []).append(i)
    for at in by_length.values():
        h = siphash13(message_words([keys[i] for i in at]), 0, 0)
        for j in range(hashes):
            out[at, j] = (h % np.uint64(bits)).astype(np.int64)
            h = siphash13(np.zeros((len(at), 1), np.uint64), 0, h)
    return out


def build(df: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """The filter of a binary column as rows (word, bits): the words of 64 bits that are not zero, combined from all tasks; nulls are left out."""

    def run(batches):
        for b in batches:
            keys = [k for k in b.column(0).to_pylist() if k is not None]
            if not keys:
                continue
            at = np.unique(positions(keys, bits, hashes))
            word, first = np.unique(at >> 6, return_index=True)
            set_ = np.bitwise_or.reduceat(np.uint64(1) << (63 - (at & 63)).astype(np.uint64), first)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(set_.view(np.int64))], ["word", "bits"])

    return df.select(col(key).cast("binary")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))


def as_bytes(words: DataFrame, bits: int) -> bytes:
    """The filter as one value of bits / 8 bytes, on the driver: for filters of at most MOST_BITS."""
    if bits > MOST_BITS:
        raise ValueError(f"a filter of over {MOST_BITS} bits stays a table of words")
    out = np.zeros(bits // 64, ">i8")
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.tobytes()


def contains(key, data: bytes, hashes: int) -> Column:
    """Whether a filter may hold a binary key; a key that was added is always found, null is not."""
    taken = np.frombuffer(data, np.uint8)

    @F.pandas_udf(T.BooleanType())
    def check(s: pd.Series) -> pd.Series:
        known = np.flatnonzero(s.notna().to_numpy())
        out = np.zeros(len(s), bool)
        if len(known):
            at = positions([bytes(s.iloc[i]) for i in known], 8 * len(taken), hashes)
            out[known] = ((taken[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
        return pd.Series(out)

    return check(col(key).cast("binary"))


def occupancy(data: bytes) -> float:
    """The share of bits that are set."""
    return float(np.unpackbits(np.frombuffer(data, np.uint8)).mean()) if data else 0.0
