"""Signatures, encryption and passwords as columns.

AES runs in Spark (GCM, whose tag covers the scheme and the key's fingerprint as
well); what Spark lacks (Ed25519, X25519, SHA3, Argon2id) runs in Arrow batches.
Everything but GCM's own nonce is a function of its inputs, so a task that is
run again gives the same keys.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import primitives as C, wire
from .hashing import sha3_256
from .packed import TEXT, row
from .values import col

AES, AGREED, PASSWORD = "aes-256", "x25519-aes-256", "password-aes-256"
SIGNATURE = "struct<algorithm: string, public_key: binary, signed_hash: binary, statement: binary, signature: binary>"
#: Argon2id's parameters: 19 MiB, two passes, one lane, salts of 16 and digests of 32 bytes (fixed values).
MEMORY, PASSES, LANES, SALT_BYTES, DIGEST_BYTES = 19456, 2, 1, 16, 32
#: Passwords whose memory is held at once.
AT_ONCE = 8


def each(f, *columns) -> list:
    """f over rows of bytes; null where any of them is."""
    return [None if any(x is None for x in row) else f(*(bytes(x) for x in row)) for row in zip(*columns)]


def fingerprint(public) -> Column:
    """What names a key: SHA3-256 of its public bytes (of the key itself, for AES), in hex."""
    return sha3_256(col(public))


@F.pandas_udf(T.BinaryType())
def ed25519_public_key(seed: pd.Series) -> pd.Series:
    return pd.Series(each(C.ed25519_public, seed), dtype=object)


@F.pandas_udf(T.BinaryType())
def x25519_public_key(secret: pd.Series) -> pd.Series:
    return pd.Series(each(C.x25519_public, secret), dtype=object)


def random_secret() -> Column:
    """32 bytes for a new secret key, from Spark's random UUIDs; not the same at another run."""
    part = lambda: F.unhex(F.sha2(F.concat(F.expr("uuid()"), F.expr("uuid()"), F.expr("uuid()")), 256))
    return part()


def ed25519_keypair(seed) -> Column:
    """(type, public, private) of a seed of 32 bytes; null for another length."""
    ok = F.octet_length(col(seed)) == 32
    return F.when(ok, F.struct(F.lit("ed25519").alias("type"), ed25519_public_key(F.when(ok, col(seed))).alias("public"), col(seed).alias("private")))


def aes_key(b) -> Column:
    """The bytes if they are an AES-256 key, else null."""
    return F.when(F.octet_length(col(b)) == 32, col(b))


def encoded_key(b, type_: str) -> Column:
    """Binary form of a key of 32 bytes; null for another length."""
    if type_ not in wire.KEY_TYPES:
        raise ValueError(f"one of {wire.KEY_TYPES}")

    @F.pandas_udf(T.BinaryType())
    def encode(s: pd.Series) -> pd.Series:
        return pd.Series([wire.encode(wire.Key(type_, bytes(x))) if x is not None and len(x) == 32 else None for x in s], dtype=object)

    return encode(col(b))


def _read(b, kind):
    try:
        v = None if b is None else wire.decode(bytes(b))
    except wire.Malformed:
        return None
    return v if isinstance(v, kind) else None


def decoded_key(b, type_: str) -> Column:
    """The key's bytes; null for anything but a key of this type."""

    @F.pandas_udf(T.BinaryType())
    def decode(s: pd.Series) -> pd.Series:
        keys = [_read(x, wire.Key) for x in s]
        return pd.Series([k.bytes if k is not None and k.type == type_ else None for k in keys], dtype=object)

    return decode(col(b))


@F.pandas_udf(T.BinaryType())
def _encoded_signature(t: pd.DataFrame) -> pd.Series:
    whole = [None not in (r.public_key, r.signed_hash, r.signature) for r in t.itertuples()]
    said = lambda x: None if x is None else wire.encode(bytes(x))
    return pd.Series([wire.encode(wire.Signature(bytes(r.signed_hash), bytes(r.public_key), bytes(r.signature), said(r.statement))) if w else None for w, r in zip(whole, t.itertuples())], dtype=object)


def encoded_signature(signature) -> Column:
    """Binary form of a signature (see signed)."""
    return _encoded_signature(col(signature))


@F.pandas_udf(row(algorithm=TEXT, public_key=T.BinaryType(), signed_hash=T.BinaryType(), statement=T.BinaryType(), signature=T.BinaryType()))
def _decoded_signature(s: pd.Series) -> pd.DataFrame:
    rows = []
    for b in s:
        v = _read(b, wire.Signature)
        said = wire.decode(v.statement) if v is not None and v.statement is not None else None
        rows.append((None,) * 5 if v is None else ("ed25519", v.public_key, v.signed_hash, bytes(said.values) if said is not None else None, v.signature))
    return pd.DataFrame(rows, columns=["algorithm", "public_key", "signed_hash", "statement", "signature"])


def decoded_signature(b) -> Column:
    """The signature in a binary form; nulls for anything else."""
    return _decoded_signature(col(b))


def _message(signed_hash, statement) -> bytes:
    return bytes(signed_hash) + (b"\0" if statement is None else b"\1" + bytes(statement))


@F.pandas_udf(T.BinaryType())
def _signed(seed: pd.Series, signed_hash: pd.Series, statement: pd.Series) -> pd.Series:
    rows = zip(seed, signed_hash, statement)
    return pd.Series([None if k is None or h is None else C.ed25519_sign(bytes(k), _message(h, s)) for k, h, s in rows], dtype=object)


@F.pandas_udf(T.BooleanType())
def _verified(public: pd.Series, signed_hash: pd.Series, statement: pd.Series, signature: pd.Series) -> pd.Series:
    rows = zip(public, signed_hash, statement, signature)
    return pd.Series([None not in (p, h) and g is not None and C.ed25519_valid(bytes(p), _message(h, s), bytes(g)) for p, h, s, g in rows])


def digest(content) -> Column:
    return F.unhex(F.sha2(col(content), 256))


def signed(content, seed, statement=None) -> Column:
    """A signature of the content's hash and, if given, a statement about it; null content is not signed."""
    said = F.lit(None).cast("binary") if statement is None else col(statement).cast("binary")
    parts = F.struct(
        F.lit("ed25519").alias("algorithm"), ed25519_public_key(col(seed)).alias("public_key"), digest(content).alias("signed_hash"),
        said.alias("statement"), _signed(col(seed), digest(content), said).alias("signature"),
    )
    return F.when(col(content).isNotNull() & col(seed).isNotNull(), parts)


def signer(content, signature) -> Column:
    """Fingerprint of the key that signed this content; null unless the hash is the content's and the signature is valid."""
    s = col(signature)
    valid = _verified(s["public_key"], s["signed_hash"], s["statement"], s["signature"])
    return F.when((s["algorithm"] == "ed25519") & (s["signed_hash"] == digest(content)) & valid, fingerprint(s["public_key"]))


def _sealed(scheme: str, name: Column, with_it: Column, content, key: Column) -> Column:
    aad = F.concat_ws("|", F.lit(scheme), name)
    body = F.aes_encrypt(col(content), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)
    return F.when(col(content).isNotNull() & key.isNotNull(), F.struct(F.lit(scheme).alias("scheme"), name.alias("fingerprint"), with_it.cast("binary").alias("with"), body.alias("ciphertext")))


def _opened(scheme: str, sealed, name: Column, key: Column) -> Column:
    s = col(sealed)
    plain = F.try_aes_decrypt(s["ciphertext"], key, F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws("|", F.lit(scheme), name))
    return F.when((s["scheme"] == scheme) & (s["fingerprint"] == name), plain)


def sealed(content, key) -> Column:
    """Bytes encrypted under a 32-byte key: scheme, fingerprint, with (null here), ciphertext."""
    return _sealed(AES, fingerprint(key), F.lit(None), content, col(key))


def opened(envelope, key) -> Column:
    """The content; null for another scheme, another key or changed bytes."""
    return _opened(AES, envelope, fingerprint(key), col(key))


@F.pandas_udf(T.BinaryType())
def _once(secret: pd.Series, content: pd.Series, public: pd.Series) -> pd.Series:
    """A secret for one message, which only the sender can derive."""
    return pd.Series(each(lambda k, c, p: hashlib.sha3_256(b"once" + k + hashlib.sha3_256(c).digest() + p).digest(), secret, content, public), dtype=object)


@F.pandas_udf(T.BinaryType())
def _agreed(secret: pd.Series, public: pd.Series) -> pd.Series:
    """SHA3-256 of the shared secret; null for points that give none."""

    def one(k, p):
        shared = C.x25519(k, p) if len(k) == len(p) == 32 else bytes(32)
        return hashlib.sha3_256(shared).digest() if any(shared) else None

    return pd.Series(each(one, secret, public), dtype=object)


def sealed_for(content, public, sender_secret) -> Column:
    """Bytes that only the owner of a public key can open; equal contents of one sender share their one-time key."""
    once = _once(col(sender_secret), col(content), col(public))
    return _sealed(AGREED, fingerprint(public), x25519_public_key(once), content, _agreed(once, col(public)))


def opened_by(envelope, secret) -> Column:
    """The content; the secret is agreed on only for envelopes that are for this key."""
    e, name = col(envelope), fingerprint(x25519_public_key(col(secret)))
    mine = (e["scheme"] == AGREED) & (e["fingerprint"] == name)
    return _opened(AGREED, envelope, name, _agreed(F.when(mine, col(secret)), e["with"]))


def _password_key(password, salt) -> Column:
    return F.unhex(sha3_256(F.concat(col(salt).cast("binary"), col(password).cast("binary"))))


def sealed_with_password(content, password, salt) -> Column:
    """Bytes under SHA3-256 of salt and password; the salt is kept."""
    key = _password_key(password, salt)
    return _sealed(PASSWORD, fingerprint(key), col(salt), content, key)


def opened_with_password(envelope, password) -> Column:
    key = _password_key(password, col(envelope)["with"])
    return _opened(PASSWORD, envelope, fingerprint(key), key)


@F.pandas_udf(T.BinaryType())
def password_digest(password: pd.Series, salt: pd.Series) -> pd.Series:
    """Argon2id of a password's bytes and its salt of 16 bytes; null where either is null or the salt has another length."""
    from .argon2 import argon2id

    out: list = [None] * len(password)
    rows = [(i, bytes(p), bytes(s)) for i, (p, s) in enumerate(zip(password, salt)) if p is not None and s is not None and len(s) == SALT_BYTES]
    for a in range(0, len(rows), AT_ONCE):
        places, words, salts = zip(*rows[a : a + AT_ONCE])
        for i, d in zip(places, argon2id(list(words), list(salts), MEMORY, PASSES, LANES, DIGEST_BYTES)):
            out[i] = d
    return pd.Series(out, dtype=object)


def stored_password(password, salt) -> Column:
    """What is kept of a password: algorithm, salt, digest and the costs."""
    d = password_digest(col(password), col(salt))
    costs = [F.lit(v).alias(n) for n, v in (("memory_kib", MEMORY), ("passes", PASSES), ("lanes", LANES))]
    return F.when(d.isNotNull(), F.struct(F.lit("argon2id").alias("algorithm"), col(salt).alias("salt"), d.alias("digest"), *costs))


def stored_matches(password, stored) -> Column:
    """Whether a password is the one kept; false for another algorithm or other costs."""
    p = col(stored)
    known = (p["algorithm"] == "argon2id") & (p["memory_kib"] == MEMORY) & (p["passes"] == PASSES) & (p["lanes"] == LANES)
    return F.coalesce(known & password_matches(password, p["salt"], p["digest"]), F.lit(False))


def opening_error(envelope, scheme: str) -> Column:
    """Why an envelope cannot be opened under a scheme before any key is tried: null if nothing speaks against it."""
    e = col(envelope)
    if scheme not in (AES, AGREED, PASSWORD):
        raise ValueError("unknown scheme")
    wrong = F.concat(F.lit("wrong scheme: "), F.coalesce(e["scheme"], F.lit("none")))
    lacks = e["with"].isNull() if scheme != AES else F.lit(False)
    return F.when(e.isNull(), "no envelope").when(~e["scheme"].eqNullSafe(F.lit(scheme)), wrong).when(lacks, "no salt or one-time key").when(F.octet_length(e["ciphertext"]) < 28, "ciphertext too short")


def password_matches(password, salt, stored) -> Column:
    return F.coalesce(password_digest(col(password), col(salt)) == col(stored), F.lit(False))
