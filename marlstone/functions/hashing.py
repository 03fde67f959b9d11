"""Content hashes and hash prefixes, over lowercase hex digests."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .values import col

PREFIX_BITS = 120


def content_hash(*cols) -> Column:
    """SHA2-256 of the canonical JSON of a record; the engine's content identity."""
    return F.sha2(F.to_json(F.struct(*map(col, cols))), 256)


def bits_of_hash(h) -> Column:
    """The leading 120 bits of a hex digest as a string of 0 and 1."""
    part = lambda a: F.lpad(F.conv(F.substring(col(h), a, 15), 16, 2), 60, "0")
    return F.concat(part(1), part(16))


def hex_of_bits(b) -> Column:
    b = F.rpad(col(b), PREFIX_BITS, "0")
    part = lambda a: F.lpad(F.lower(F.conv(F.substring(b, a, 60), 2, 16)), 15, "0")
    return F.concat(part(1), part(61))


def prefix(h, bits: int) -> Column:
    """The first `bits` bits of a digest, the rest zero, as 30 hex digits."""
    if not 0 <= bits <= PREFIX_BITS:
        raise ValueError("a prefix has 0 to 120 bits")
    return hex_of_bits(F.substring(bits_of_hash(h), 1, bits) if bits else F.lit(""))


def lower_bound(p, bits: int, digits: int = 64) -> Column:
    return F.rpad(F.substring(col(p), 1, (bits + 3) // 4), digits, "0")


def upper_bound(p, bits: int, digits: int = 64) -> Column:
    """The highest digest with this prefix: all later bits set."""
    whole, rest = divmod(bits, 4)
    head = F.substring(col(p), 1, whole) if whole else F.lit("")
    if rest:
        nibble = F.conv(F.substring(col(p), whole + 1, 1), 16, 10).cast("int").bitwiseOR(F.lit((1 << (4 - rest)) - 1))
        head = F.concat(head, F.lower(F.conv(nibble.cast("string"), 10, 16)))
    return F.rpad(head, digits, "f")


def matches(h, prefix_hex: str, bits: int) -> Column:
    """Whether a digest has the prefix, as a range over the digest, which scans can prune by."""
    if bits == 0:
        return F.lit(True)
    value = int(prefix_hex.ljust(64, "0")[:64], 16) >> (256 - bits) << (256 - bits)
    return col(h).between(f"{value:064x}", f"{value | (1 << (256 - bits)) - 1:064x}")


def child(p, bits: int, more: int, nth) -> Column:
    """The nth of the 2^more prefixes that extend p by `more` bits."""
    if bits + more > PREFIX_BITS:
        raise ValueError("a prefix has 0 to 120 bits")
    tail = F.lpad(F.conv(col(nth).cast("string"), 10, 2), more, "0")
    return hex_of_bits(F.concat(F.substring(bits_of_hash(p), 1, bits) if bits else F.lit(""), tail))


def which_child(h, bits: int, more: int) -> Column:
    """The number that the `more` bits after the first `bits` spell."""
    return F.conv(F.substring(bits_of_hash(h), bits + 1, more), 2, 10).cast("long")


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter for n keys at false-positive rate p; bits are a multiple of 256."""
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return -(-m // 256) * 256, max(1, round(-math.log(p) / math.log(2)))


def bloom_positions(key, bits: int, hashes: int) -> Column:
    """The key's bits: two halves of its MD5, one stepped by the other."""
    d = F.md5(col(key).cast("string").cast("binary"))
    a, b = (F.conv(F.substring(d, at, 7), 16, 10).cast("long") for at in (1, 8))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)).cast("long"))


@pandas_udf(T.StringType())
def sha3_256(b):
    """SHA3-256 of bytes, in hex; Spark has no such function."""
    import hashlib

    return b.map(lambda x: None if x is None else hashlib.sha3_256(bytes(x)).hexdigest())


def sha3_256_text(c) -> Column:
    """SHA3-256 of a text's UTF-8 bytes, in hex, in the JVM; bytes that are no text need sha3_256."""
    return F.when(col(c).isNotNull(), F.reflect(F.lit("org.apache.commons.codec.digest.DigestUtils"), F.lit("sha3_256Hex"), col(c)))


@pandas_udf(T.StringType())
def blake3_256(b):
    """BLAKE3-256 of bytes, in hex; the blocks of a batch are compressed together."""
    import pandas as pd

    from .primitives import blake3_many

    at = [i for i, x in enumerate(b) if x is not None]
    out = [None] * len(b)
    for i, d in zip(at, blake3_many([bytes(b.iloc[i]) for i in at])):
        out[i] = d.hex()
    return pd.Series(out, dtype=object)


#: Algorithms by name: bytes of a digest (fixed values).
DIGESTS = {"MD5": 16, "SHA1": 20, "SHA2": 32, "SHA3": 32, "Blake3": 32}


def hash_of(algorithm: str, *parts) -> Column:
    """Digest of the bytes of all parts, one after the other, as (algo, digest in hex); null if a part is."""
    whole = F.concat(*[col(p).cast("binary") for p in parts])
    digests = {"MD5": F.md5, "SHA1": F.sha1, "SHA2": lambda b: F.sha2(b, 256), "SHA3": sha3_256, "Blake3": blake3_256}
    return F.when(whole.isNotNull(), F.struct(F.lit(algorithm).alias("algo"), digests[algorithm](whole).alias("digest")))


def zero_hash(algorithm: str) -> Column:
    """The digest of all zeros that stands for none."""
    return F.struct(F.lit(algorithm).alias("algo"), F.lit("00" * DIGESTS[algorithm]).alias("digest"))


def random_hash(algorithm: str, seed: int | None = None) -> Column:
    """A digest of random bytes; with a seed the same ones at every run over the same partitions."""
    n = DIGESTS[algorithm]
    words = [F.lpad(F.lower(F.hex(F.floor((F.rand() if seed is None else F.rand(seed + i)) * float(1 << 32)).cast("long"))), 8, "0") for i in range(n // 4)]
    return F.struct(F.lit(algorithm).alias("algo"), F.concat(*words).alias("digest"))
