"""Argon2id version 0x13 (RFC 9106) over a batch of passwords: the batch is NumPy's inner axis."""

from __future__ import annotations

import hashlib
from struct import pack

import numpy as np

SLICES, VERSION, KIND = 4, 0x13, 2
LOW = np.uint64(0xFFFFFFFF)
#: Words that the second half of a block's mixing treats as one row.
COLUMNS = np.array([[2 * i + 16 * j + k for j in range(8) for k in (0, 1)] for i in range(8)]).T
ROWS = np.arange(128).reshape(8, 16).T


def _h(size: int, *parts: bytes) -> bytes:
    """The variable-length hash."""
    x = pack("<I", size) + b"".join(parts)
    if size <= 64:
        return hashlib.blake2b(x, digest_size=size).digest()
    v, out = hashlib.blake2b(x).digest(), b""
    while size - len(out) > 64:
        out += v[:32]
        rest = size - len(out)
        v = hashlib.blake2b(v, digest_size=min(64, rest)).digest()
    return out + v


def _turn(x, n):
    return x >> np.uint64(n) | x << np.uint64(64 - n)


def _quarter(a, b, c, d):
    def plus(x, y):
        return x + y + ((x & LOW) * (y & LOW) << np.uint64(1))

    a = plus(a, b)
    d = _turn(d ^ a, 32)
    c = plus(c, d)
    b = _turn(b ^ c, 24)
    a = plus(a, b)
    d = _turn(d ^ a, 16)
    c = plus(c, d)
    return a, _turn(b ^ c, 63), c, d


def _mix(x, y):
    """The compression of two blocks, each (128, batch)."""
    r = x ^ y
    z = r.copy()
    for order in (ROWS, COLUMNS):
        a, b, c, d = z[order].reshape(4, 4, 8, -1)
        a, b, c, d = _quarter(a, b, c, d)
        a, b, c, d = _quarter(a, b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]])
        z[order] = np.concatenate([a, b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]])
    return z ^ r


def _addresses(count: int, *head: int):
    """The data-independent choices of a segment."""
    zero, out = np.zeros((128, 1), np.uint64), []
    for counter in range(1, -(-count // 128) + 1):
        z = zero.copy()
        z[:7, 0] = [*head, counter]
        out.append(_mix(zero, _mix(zero, z))[:, 0])
    return np.concatenate(out)


def argon2id(passwords: list[bytes], salts: list[bytes], memory: int = 19456, passes: int = 2, lanes: int = 1, size: int = 32, secret: bytes = b"", data: bytes = b"") -> list[bytes]:
    """A digest of `size` bytes for each password and its salt; memory is in KiB for each of them."""
    n = len(passwords)
    if not n:
        return []
    if memory < 8 * lanes or min(passes, lanes) < 1 or size < 4:
        raise ValueError("memory, passes, lanes or size too small")
    part = memory // (SLICES * lanes)
    width, everyone = part * SLICES, np.arange(n)
    m = np.zeros((lanes, width, 128, n), np.uint64)
    for k, (password, salt) in enumerate(zip(passwords, salts)):
        fields = b"".join(pack("<I", len(x)) + x for x in (password, salt, secret, data))
        seed = hashlib.blake2b(pack("<6I", lanes, size, memory, passes, VERSION, KIND) + fields).digest()
        for lane in range(lanes):
            for i in range(2):
                m[lane, i, :, k] = np.frombuffer(_h(1024, seed, pack("<II", i, lane)), "<u8")
    for turn in range(passes):
        for s in range(SLICES):
            for lane in range(lanes):
                fixed = _addresses(part, turn, lane, s, width * lanes, passes, KIND) if turn == 0 and s < 2 else None
                for i in range(2 if turn == s == 0 else 0, part):
                    at = s * part + i
                    last = m[lane, at - 1]
                    j = np.full(n, fixed[i]) if fixed is not None else last[0]
                    source = np.full(n, lane) if turn == s == 0 else ((j >> np.uint64(32)) % np.uint64(lanes)).astype(np.int64)
                    ready = (s if turn == 0 else SLICES - 1) * part
                    area = np.where(source == lane, ready + i - 1, ready - (i == 0)).astype(np.uint64)
                    x = j & LOW
                    back = area * (x * x >> np.uint64(32)) >> np.uint64(32)
                    start = 0 if turn == 0 or s == SLICES - 1 else (s + 1) * part
                    other = (start + (area - np.uint64(1) - back).astype(np.int64)) % width
                    new = _mix(last, m[source, other, :, everyone].T)
                    m[lane, at] = new if turn == 0 else new ^ m[lane, at]
    final = np.bitwise_xor.reduce(m[:, -1], axis=0)
    return [_h(size, np.ascontiguousarray(final[:, k]).astype("<u8").tobytes()) for k in range(n)]
