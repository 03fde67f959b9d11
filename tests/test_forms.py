"""Binary forms of packed vectors, bits, documents, keys, signatures and transactions; Bloom filters; documents and logs."""

import random
import subprocess
import sys
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import bloom, hashing, packed, primitives, wire
from marlstone.operators import documents as D, txlog as X
from marlstone.streaming.dedup import counts_by_kind

FORMS = [
    wire.Packed("f32", (1.0, 2.5)), wire.Packed("f64", (1.0, -2.0, 3.0)), wire.Packed("i16", (1, -2, 3, 4, 5, 6), (2, 3)), wire.Packed("u128", (1 << 127, 5)), wire.Packed("i128", (-1234,) * 3), wire.Packed("uuid", (uuid.UUID(int=5),)),
    wire.Packed("u64", (0xF00DDEADBEEFF00D,) * 3), wire.Packed("blake3", (b"h" * 32,)), wire.Packed("u8", ()), *[wire.Bits(tuple(i % 2 == 0 for i in range(n))) for n in [*range(16), *range(100, 130)]], wire.Password(b"s" * 16, b"d" * 32),
    wire.Key("Ed25519Public", b"k" * 32), wire.Key("X25519Private", b"k" * 32), wire.Key("Aes256", b"k" * 32), wire.Signature(b"h" * 32, b"p" * 32, b"s" * 64, wire.encode("NOT")), wire.Signature(b"h" * 32, b"p" * 32, b"s" * 64),
    wire.CipherMeta(1, b"f" * 32, b"i" * 16, b"m" * 32), wire.CipherMeta(2, b"f" * 32, b"i" * 32, b"m" * 32), wire.Document(wire.encode(42), wire.encode("7 (good) times 6 (evil)"), ((b"a" * 32, b"b" * 32),)),
    wire.Transaction(b"\x09" * 32, b"k" * 32, (bytes(32),), (b"\1" * 32,), ((b"\3" * 32, b"\4" * 32),), (b"\2" * 32,), ((b"\5" * 32, b"\6" * 32),), b"s" * 64),
]


@pytest.mark.parametrize("v", FORMS, ids=lambda v: f"{type(v).__name__}-{len(wire.encode(v))}")
def test_forms_come_back(v):
    b = wire.encode(v)
    assert len(b) % 8 == 0 and wire.decode(b) == v
    for cut in (1, len(b) // 2, len(b) - 1):
        with pytest.raises(wire.Malformed):
            wire.decode(b[:cut])
    wire.plain(v)


def test_exact_bytes():
    assert len(wire.encode(wire.Packed("u8", tuple(range(8))))) == 24
    assert wire.encode(wire.Bits((True, False, True))) == bytes.fromhex("000e080001000000" "05a0000000000000")
    assert wire.encode(wire.Single(1.0)) == bytes.fromhex("000004000000803f") and wire.decode(wire.encode(wire.Single(1.0))) == 1.0
    assert wire.decode(wire.encode(b"x")) == wire.Packed("u8", (120,))


@pytest.mark.parametrize("v", [wire.Packed("u8", (256,)), wire.Packed("u8", (None,)), wire.Packed("u512", ()), wire.Packed("u8", (1, 2), (3,)), wire.Key("None", b"k" * 32), wire.Key("Aes256", b"k"), wire.CipherMeta(3, b"f" * 32, b"", b"m" * 32), {1: 2, "a": 3}], ids=repr)
def test_what_has_no_form(v):
    with pytest.raises(wire.Malformed):
        wire.encode(v)


def test_signedness_is_a_border():
    assert wire.decode_as(wire.encode(5), "SignedInt") == 5 and wire.decode_as(wire.encode(wire.Unsigned(5)), "UnsignedInt") == wire.Unsigned(5)
    for b, kind in ((wire.encode(5), "UnsignedInt"), (wire.encode(wire.Unsigned(5)), "SignedInt")):
        with pytest.raises(wire.Malformed):
            wire.decode_as(b, kind)


def test_columns_of_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],), (None,), ([1e300],)], "a array<double>")
    got = [r.t for r in df.select(packed.unpacked(packed.packed("a", "i32")).alias("t")).collect()]
    assert got[0].asDict() == {"element": "i32", "dims": [2], "data": [1.0, 2.0]} and got[1].dims == [0] and got[2].data is None and got[3].data is None
    bits = spark.createDataFrame([([True, False] * 50,), ([],), (None,)], "a array<boolean>")
    assert [r.b for r in bits.select(packed.unpacked_bits(packed.packed_bits("a")).alias("b")).collect()] == [[True, False] * 50, [], None]


def test_siphash_is_the_interpreter_s():
    code = "print(*[hash(bytes(range(n))) & (1 << 64) - 1 for n in range(1, 60)])"
    want = subprocess.run([sys.executable, "-c", f"import sys; assert sys.hash_info.algorithm == 'siphash13'; {code}"], env={"PYTHONHASHSEED": "0"}, capture_output=True, text=True).stdout.split()
    assert want == [str(int(bloom.siphash13(bloom.message_words([bytes(range(n))]), 0, 0)[0])) for n in range(1, 60)]


def test_bloom_filter_of_the_even_numbers(spark):
    bits, hashes = hashing.bloom_size(200, 0.01)
    keys = spark.createDataFrame([(i.to_bytes(8, "little"),) for i in range(0, 400, 2)] + [(None,), (b"",)], "k binary").repartition(3)
    data = bloom.as_bytes(bloom.build(keys, "k", bits, hashes), bits)
    assert len(data) == bits // 8 and 0.2 < bloom.occupancy(data) < 0.6
    asked = spark.createDataFrame([(i, i.to_bytes(8, "little")) for i in range(400)] + [(-1, None)], "i int, k binary")
    found = {r.i for r in asked.where(bloom.contains("k", data, hashes)).collect()}
    assert set(range(0, 400, 2)) <= found and len(found) < 205 and -1 not in found
    with pytest.raises(ValueError):
        bloom.as_bytes(bloom.build(keys, "k", bits, hashes), 1 << 40)


def test_blake3_of_many_is_that_of_each():
    r = random.Random(1)
    messages = [r.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 4096, 5000, 8193, 20_000)]
    assert primitives.blake3_many(messages) == [primitives.blake3(m) for m in messages] and primitives.blake3_many([]) == []


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("ab", "c"), ("", ""), (None, "x")], "a string, b string")
    got = df.select(*[hashing.hash_of(n, "a", "b").alias(n) for n in hashing.DIGESTS], hashing.sha3_256_text("a").alias("s"), hashing.random_hash("SHA1", 3).alias("r")).collect()
    assert got[0].SHA3.digest == hashlib.sha3_256(b"abc").hexdigest() and got[0].MD5.digest == hashlib.md5(b"abc").hexdigest() and got[2].SHA2 is None
    assert got[0].Blake3.digest == primitives.blake3(b"abc").hex() and got[0].s == hashlib.sha3_256(b"ab").hexdigest() and got[2].s is None
    assert len({r.r.digest for r in got}) == 3 and all(len(r.r.digest) == 40 for r in got)


def test_documents(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, body string")
    docs = D.new(rows, "id", "body")
    assert all(r.prev_versions == [] for r in docs.collect())
    changes = docs.where("id = 1").select("doc_hash", F.lit("a2").alias("body"), F.lit("t" * 64).alias("from_tx")).unionByName(spark.createDataFrame([("none", "x", "t")], "doc_hash string, body string, from_tx string"))
    after = D.update(docs, changes).collect()
    assert [(r.id, r.body, len(r.prev_versions)) for r in after] == [(1, "a2", 1)] and after[0].prev_versions[0].from_tx == "t" * 64
    every = docs.unionByName(D.update(docs, changes))
    assert sorted(r.body for r in D.heads(every).collect()) == ["a2", "b"]
    assert D.with_body(docs, F.lit("z")).select("doc_hash").distinct().count() == 2
    many = spark.range(1).select(F.lit(1).alias("id"), F.lit("b").alias("body"), F.array_repeat(D.version(F.lit("d"), F.lit("t")), 65536).alias("old"))
    with pytest.raises(Exception, match="65535"):
        D.replace(many, "id", "body", "old").collect()


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 30, 65])
def test_depths_of_chains(spark, n):
    ref = lambda k: [] if k == 0 else [(f"h{k - 1}", "t")]
    docs = spark.createDataFrame([(f"h{k}", ref(k)) for k in range(n)], "doc_hash string, prev_versions array<struct<document: string, from_tx: string>>")
    assert {r.doc_hash: r.depth for r in D.depths(docs).collect()} == {f"h{k}": k for k in range(n)}


def test_transactions(spark):
    changes = spark.createDataFrame([("t1", "aa", False, None, False), ("t1", "bb", False, None, True), ("t2", "aa", True, "t1", False), ("t2", "bb", True, "t1", True)], "tx_hash string, object_hash string, deletes boolean, source_tx string, extent boolean")
    parents = spark.createDataFrame([("t2", "t1"), ("t1", None)], "tx_hash string, previous_tx string")
    log = X.build(changes, collection=F.lit("c0" * 32), parents=parents, public_key=F.lit("k"))
    by = {r.tx_hash: r for r in log.collect()}
    assert by["t1"].previous_txs == [] and by["t2"].previous_txs == ["t1"] and by["t2"].collection == "c0" * 32 and by["t1"].public_key == "k"
    assert X.extent_adds(log).collect()[0].object_hash == "bb" and X.extent_deletes(log).collect()[0].source_tx == "t1"
    assert X.live(log).count() == 0 and [r.tx_hash for r in X.heads(log).collect()] == ["t2"]
    assert spark.createDataFrame([(b"junk",), (None,)], "b binary").select(X.decoded("b").alias("t")).where("t.collection is not null").count() == 0


def test_counts_by_kind_of_a_stream(spark, tmp_path):
    data = [("2024-01-01 00:10:00", "1"), ("2024-01-01 00:20:00", '"x"'), ("2024-01-01 00:50:00", "2"), ("2024-01-01 05:00:00", "{}")]
    spark.createDataFrame(data, "ts string, j string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "j").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, j string").parquet(f"{tmp_path}/in")
    q = counts_by_kind(stream, "j", "ts").writeStream.format("memory").queryName("kinds").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r.window.start), r.kind): r.n for r in spark.table("kinds").collect()}
    assert got == {("2024-01-01 00:00:00", "SignedInt"): 2, ("2024-01-01 00:00:00", "String"): 1}


def test_positions_are_the_chain_of_hashes():
    h = bloom.siphash13(bloom.message_words([b"key"]), 0, 0)
    want = []
    for _ in range(3):
        want.append(int(h[0]) % 512)
        h = bloom.siphash13(np.zeros((1, 1), np.uint64), 0, h)
    assert bloom.positions([b"key", b"longer key"], 512, 3)[0].tolist() == want
