"""Primitives against published vectors; prefixes, bits, order, documents, logs and streams on small inputs."""

import hashlib

from pyspark.sql import functions as F

from marlstone.functions import bits, hashing, primitives as C, values
from marlstone.operators import documents, txlog
from marlstone.operators.ranking import row_numbers


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_blake3_vectors():
    assert C.blake3(b"").hex().startswith("af1349b9f5f9a1a6a0404dea36dcc949")
    assert C.blake3(bytes(i % 251 for i in range(1025))).hex().startswith("d00278ae")
    assert int.from_bytes(C.blake3(b"hunter2")[:2], "big") & 0xFFF != 0


def test_ed25519_vector():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public, sig = C.ed25519_public(seed), C.ed25519_sign(seed, b"")
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert C.ed25519_valid(public, b"", sig) and not C.ed25519_valid(public, b"x", sig)
    assert not C.ed25519_valid(public, b"", sig[:-1] + bytes([sig[-1] ^ 1]))


def test_x25519_agrees():
    a, b = bytes(range(32)), bytes(range(32, 64))
    assert C.x25519(a, C.x25519(b)) == C.x25519(b, C.x25519(a))


def test_hash_prefixes(spark):
    dead = F.lit("dead" + "0" * 60)
    assert one(spark, hashing.prefix(dead, 12)) == "dea" + "0" * 27
    assert one(spark, hashing.child(hashing.prefix(dead, 12), 12, 5, F.lit(27))) == "dead8" + "0" * 25
    assert one(spark, hashing.upper_bound(F.lit("dea"), 12, 32)) == "dea" + "f" * 29
    h = F.lit(C.blake3(b"hunter2").hex())
    assert [one(spark, hashing.which_child(h, 4, n)) for n in (4, 8, 12)] == [5, 93, 1500]
    assert one(spark, hashing.matches(h, "", 0)) is True
    assert len(one(spark, hashing.prefix(h, 120))) == 30


def test_sha3(spark):
    got = spark.range(1).select(hashing.sha3_256(F.encode(F.lit("abc"), "UTF-8")).alias("h")).first()["h"]
    assert got == hashlib.sha3_256(b"abc").hexdigest()


def test_bits(spark):
    assert one(spark, bits.bits_of(F.lit(0b10110000))) == [True, False, True, True, False, False, False, False]
    assert one(spark, bits.packed(F.array(F.lit(True), F.lit(False), F.lit(True)))) == 5


def test_kinds(spark):
    rows = [("1",), ("1.5",), ("true",), ("null",), ('"x"',), ("[1]",), ('{"a":1}',), ("{",), (None,)]
    df = spark.createDataFrame(rows, "j string").select(values.kind(values.parsed("j")).alias("k"))
    assert [r.k for r in df.collect()] == ["SignedInt", "Float", "Bool", "Unit", "String", "Vec", "Object", None, None]


def test_times_before_1970_round_down(spark):
    assert one(spark, values.micros_of_nanos("CAST(-1 AS BIGINT)")) == -1


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert {r.x: r.rn for r in row_numbers(df, ["x desc"]).collect()} == {x: 1000 - x for x in range(1000)}
    assert row_numbers(spark.range(0), ["id"]).count() == 0


def test_documents(spark):
    log = spark.createDataFrame([(1, i, "b") for i in range(1, 13)] + [(2, 99, "c")], "id long, seq long, body string")
    docs = documents.history(log, "id", "body", ["seq"])
    assert {r.seq for r in documents.heads(docs).collect()} == {12, 99}
    assert {r.seq for r in documents.merges(docs).collect()} == {10}
    assert sorted(r.depth for r in documents.depths(docs).collect()) == [0, *range(12)]
    assert documents.renamed(docs, F.lit(5)).where("size(prev_versions) > 0").count() == 0


def test_a_delete_names_its_transaction(spark):
    log = txlog.build(spark.createDataFrame([("t1", "o", False, None), ("t2", "o", False, None), ("t3", "o", True, "t1")], "tx_hash string, object_hash string, deletes boolean, source_tx string"))
    assert [tuple(r) for r in txlog.live(log).select("object_hash", "tx_hash").collect()] == [("o", "t2")]


def test_stream_sees_content_once(spark, sf, tmp_path):
    from marlstone.streaming.dedup import first_seen

    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "props").limit(300)
    events.unionByName(events).repartition(2).write.parquet(str(src))
    stream = first_seen(spark.readStream.schema(events.schema).parquet(str(src)), ["props", "ts"], "ts", "100 days")
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == events.distinct().count()
