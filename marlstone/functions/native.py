"""Ed25519 and X25519 by the OpenSSL that Python's hashlib is linked with, where it can be reached.

Each function gives None where it cannot tell (no library, other lengths, an
error); `primitives` then works it out itself, so results are the same.
"""

from __future__ import annotations

import ctypes
from ctypes import byref, c_char_p, c_int, c_size_t, c_void_p, create_string_buffer

X25519, ED25519 = 1034, 1087  # OpenSSL's numbers of the algorithms
_RESULT, _KEY = c_int, c_void_p
_SIGNATURES = {
    "EVP_PKEY_new_raw_private_key": (_KEY, c_int, c_void_p, c_char_p, c_size_t), "EVP_PKEY_new_raw_public_key": (_KEY, c_int, c_void_p, c_char_p, c_size_t),
    "EVP_PKEY_get_raw_public_key": (_RESULT, _KEY, c_char_p, c_void_p), "EVP_PKEY_free": (None, _KEY),
    "EVP_PKEY_CTX_new": (c_void_p, _KEY, c_void_p), "EVP_PKEY_CTX_free": (None, c_void_p), "EVP_PKEY_derive_init": (_RESULT, c_void_p),
    "EVP_PKEY_derive_set_peer": (_RESULT, c_void_p, _KEY), "EVP_PKEY_derive": (_RESULT, c_void_p, c_char_p, c_void_p),
    "EVP_MD_CTX_new": (c_void_p,), "EVP_MD_CTX_free": (None, c_void_p),
    "EVP_DigestSignInit": (_RESULT, c_void_p, c_void_p, c_void_p, c_void_p, _KEY), "EVP_DigestSign": (_RESULT, c_void_p, c_char_p, c_void_p, c_char_p, c_size_t),
    "EVP_DigestVerifyInit": (_RESULT, c_void_p, c_void_p, c_void_p, c_void_p, _KEY), "EVP_DigestVerify": (_RESULT, c_void_p, c_char_p, c_size_t, c_char_p, c_size_t),
    "ERR_clear_error": (None,),
}


def _load():
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)  # its symbols include those of the library it is linked with
        for name, (gives, *takes) in _SIGNATURES.items():
            f = getattr(lib, name)
            f.restype, f.argtypes = gives, takes
        return lib
    except (ImportError, OSError, AttributeError):
        return None


LIB = _load()


def _private(kind: int, secret: bytes):
    return LIB.EVP_PKEY_new_raw_private_key(kind, None, secret, 32) if LIB is not None and len(secret) == 32 else None


def _cleared(found):
    """found; where it is None, what the library noted about the error is dropped."""
    if found is None and LIB is not None:
        LIB.ERR_clear_error()
    return found


def public(kind: int, secret: bytes) -> bytes | None:
    key = _private(kind, secret)
    if not key:
        return _cleared(None)
    out, n = create_string_buffer(32), c_size_t(32)
    try:
        return _cleared(out.raw if LIB.EVP_PKEY_get_raw_public_key(key, out, byref(n)) == 1 else None)
    finally:
        LIB.EVP_PKEY_free(key)


def agreed(secret: bytes, point: bytes) -> bytes | None:
    """The shared secret; None also where it would be zero."""
    key = _private(X25519, secret) if len(point) == 32 else None
    if not key:
        return _cleared(None)
    peer = ctx = None
    try:
        peer, ctx = LIB.EVP_PKEY_new_raw_public_key(X25519, None, point, 32), LIB.EVP_PKEY_CTX_new(key, None)
        out, n = create_string_buffer(32), c_size_t(32)
        good = peer and ctx and LIB.EVP_PKEY_derive_init(ctx) == 1 and LIB.EVP_PKEY_derive_set_peer(ctx, peer) == 1 and LIB.EVP_PKEY_derive(ctx, out, byref(n)) == 1
        return _cleared(out.raw if good else None)
    finally:
        LIB.EVP_PKEY_CTX_free(ctx)
        LIB.EVP_PKEY_free(peer)
        LIB.EVP_PKEY_free(key)


def sign(seed: bytes, message: bytes) -> bytes | None:
    key = _private(ED25519, seed)
    if not key:
        return _cleared(None)
    ctx = LIB.EVP_MD_CTX_new()
    try:
        out, n = create_string_buffer(64), c_size_t(64)
        good = ctx and LIB.EVP_DigestSignInit(ctx, None, None, None, key) == 1 and LIB.EVP_DigestSign(ctx, out, byref(n), message, len(message)) == 1
        return _cleared(out.raw if good else None)
    finally:
        LIB.EVP_MD_CTX_free(ctx)
        LIB.EVP_PKEY_free(key)


def valid(point: bytes, message: bytes, signature: bytes) -> bool | None:
    """Whether a signature of 64 bytes holds under a public key, the encoding of which has been checked."""
    key = LIB.EVP_PKEY_new_raw_public_key(ED25519, None, point, 32) if LIB is not None and len(point) == 32 else None
    if not key:
        return _cleared(None)
    ctx = LIB.EVP_MD_CTX_new()
    try:
        if not ctx or LIB.EVP_DigestVerifyInit(ctx, None, None, None, key) != 1:
            return _cleared(None)
        good = LIB.EVP_DigestVerify(ctx, signature, len(signature), message, len(message)) == 1
        if not good:
            LIB.ERR_clear_error()
        return good
    finally:
        LIB.EVP_MD_CTX_free(ctx)
        LIB.EVP_PKEY_free(key)
