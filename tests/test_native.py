"""OpenSSL's curves against the plain ones, and costly rows in many tasks."""

import random

import pytest

from marlstone.functions import native, primitives as C
from marlstone.plans import registry


def both(monkeypatch, f):
    """f's result with the library and without."""
    C.ed25519_public.cache_clear(), C.x25519_public.cache_clear()
    with_it = f()
    with monkeypatch.context() as m:
        m.setattr(native, "LIB", None)
        C.ed25519_public.cache_clear(), C.x25519_public.cache_clear()
        return with_it, f()


def test_curves_agree(monkeypatch):
    r = random.Random(7)
    for size in (0, 3, 200):
        seed, other, message = r.randbytes(32), r.randbytes(32), r.randbytes(size)
        for f in (
            lambda: C.ed25519_public(seed), lambda: C.ed25519_sign(seed, message), lambda: C.x25519_public(seed), lambda: C.x25519(seed, C.x25519_public(other)),
            lambda: C.ed25519_valid(C.ed25519_public(seed), message, C.ed25519_sign(seed, message)),
        ):
            a, b = both(monkeypatch, f)
            assert a == b and a is not False


def test_odd_points_and_signatures_agree(monkeypatch):
    r = random.Random(8)
    seed = r.randbytes(32)
    key, good = C.ed25519_public(seed), C.ed25519_sign(seed, b"m")
    le = lambda n: n.to_bytes(32, "little")
    keys = [key, r.randbytes(32), bytes(32), *[le(n | top << 255) for n in (0, 1, C.P - 1, C.P, C.P + 1, C.P + 3) for top in (0, 1)], b"short"]
    bad = bytes([good[0] ^ 1]) + good[1:]
    signatures = [good, bad, good[:32] + le(int.from_bytes(good[32:], "little") + C.Q), le(1) + bytes(32), le(1 | 1 << 255) + bytes(32), le(C.P + 1) + bytes(32), bytes(64), b""]
    for k in keys:
        for s in signatures:
            a, b = both(monkeypatch, lambda: C.ed25519_valid(k, b"m", s))
            assert a is b, (k, s)
    for u in (bytes(32), le(1), le(C.P), le(C.P - 1), le(9 | 1 << 255), le(C.P + 9), r.randbytes(32)):
        a, b = both(monkeypatch, lambda: C.x25519(seed, u))
        assert a == b


@pytest.mark.parametrize("name", ["sealed_roundtrip", "txlog_form", "txlog_signed"])
def test_costly_rows_are_in_many_tasks(spark, sf, name):
    assert registry.queries()[name](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
