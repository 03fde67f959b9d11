"""Signatures, envelopes and passwords: published vectors, round trips, every way to be wrong."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import sealing as S
from marlstone.functions.argon2 import argon2id
from marlstone.operators import txlog



def seed():
    return F.lit(bytes(range(32)))


def other():
    return F.lit(bytes(range(1, 33)))


def test_argon2id_vector():
    """RFC 9106, section 5.3."""
    tag = argon2id([b"\1" * 32] * 2, [b"\2" * 16] * 2, 32, 3, 4, 32, b"\3" * 8, b"\4" * 12)
    assert {t.hex() for t in tag} == {"0d640df58d78766c08c037a34a8b53c9d01ef0452d75b65eb52520e96b01e659"}


def test_argon2id_batches_agree():
    words, salts = [b"a", b"", b"long" * 50], [b"s" * 16, b"t" * 16, b"u" * 16]
    assert argon2id(words, salts, 64, 2, 1) == [argon2id([w], [s], 64, 2, 1)[0] for w, s in zip(words, salts)]
    assert argon2id([], []) == []


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(0, b"one"), (1, b""), (2, "zwei é".encode() * 500), (3, None)], "id int, content binary")


def test_signatures(rows):
    signed = rows.select("*", S.signed("content", seed()).alias("bare"), S.signed("content", seed(), F.lit(b"reviewed")).alias("said"))
    changed = F.concat("content", F.lit(b"!"))
    lie = F.col("said").withField("statement", F.lit(b"rejected"))
    got = signed.select(
        "id", "bare", S.signer("content", "bare").alias("a"), S.signer("content", "said").alias("b"), S.signer(changed, "bare").alias("c"),
        S.signer("content", lie).alias("d"), S.signer("content", F.col("said").withField("statement", F.lit(None).cast("binary"))).alias("e"), S.fingerprint(S.ed25519_public_key(seed())).alias("f"),
    ).orderBy("id").collect()
    for r in got[:3]:
        assert r["a"] == r["b"] == r["f"] and r["c"] is r["d"] is r["e"] is None
    assert got[3]["bare"] is got[3]["a"] is None


def test_envelopes(rows):
    mine = rows.select("*", S.sealed("content", seed()).alias("k"), S.sealed_with_password("content", F.lit(b"pw"), F.lit(b"s" * 16)).alias("p"), S.sealed_for("content", S.x25519_public_key(seed()), other()).alias("x"))
    moved = F.col("k").withField("fingerprint", S.fingerprint(other()))
    got = mine.select(
        "id", "content", "k", S.opened("k", seed()).alias("a"), S.opened_with_password("p", F.lit(b"pw")).alias("b"), S.opened_by("x", seed()).alias("c"),
        F.coalesce(S.opened("k", other()), S.opened(moved, other()), S.opened_with_password("p", F.lit(b"no")), S.opened_by("x", other()), S.opened("x", seed()), S.opened_by("k", seed())).alias("wrong"),
    ).orderBy("id").collect()
    for r in got:
        assert r["a"] == r["b"] == r["c"] == r["content"] and r["wrong"] is None
    assert got[3]["k"] is None


def test_agreement_refuses_points_of_small_order(rows):
    assert rows.select(S.sealed_for("content", F.lit(bytes(32)), other()).alias("x")).where("x is not null").count() == 0


def test_passwords(spark, monkeypatch):
    df = spark.createDataFrame([(b"hunter2", b"s" * 16), (None, b"s" * 16), (b"x", b"short")], "p binary, s binary")
    got = df.select(S.password_digest("p", "s").alias("d")).collect()
    assert got[0]["d"] == argon2id([b"hunter2"], [b"s" * 16])[0] and got[1]["d"] is got[2]["d"] is None
    d = F.lit(bytes(got[0]["d"]))
    assert [r[0] for r in df.limit(1).select(S.password_matches("p", "s", d)).collect() + df.limit(1).select(S.password_matches(F.lit(b"hunter3"), "s", d)).collect()] == [True, False]


def test_signed_logs(spark):
    changes = spark.createDataFrame([("t1", "a", False, None, False), ("t1", "x", False, None, True), ("t2", "a", True, "t1", False), ("t2", "x", True, "t1", True)], "tx_hash string, object_hash string, deletes boolean, source_tx string, extent boolean")
    log = txlog.build(changes)
    assert [r["extents_added"] for r in log.orderBy("tx_hash").collect()] == [["x"], []]
    signed = txlog.signed(log, seed())
    tampered = signed.withColumn("values_added", F.when(F.col("tx_hash") == "t2", F.array(F.lit("b"))).otherwise(F.col("values_added")))
    assert {r["tx_hash"]: r["sig_valid"] for r in txlog.checked(tampered).collect()} == {"t1": True, "t2": False}
