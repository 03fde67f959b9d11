"""The binary form: round trips, exact bytes, malformed input."""

import uuid

import pytest
from hypothesis import given, settings, strategies as st

from marlstone.functions.wire import Char, Digest, Malformed, Nanos, Record, Unit, Unsigned, decode, encode, read

VALUES = [
    None, True, False, 0, -1, 2**31, -(2**63), 2**100, Unsigned(7), Unsigned(2**64 - 1), 1.5, "", "hunter2", "é🦋", Char("K"), Char("🦋"), [], [42, 42.0, "world"], [[None]], (8, 6, 7, 5, 3, 0),
    {"Liara": "T'Soni", "Garrus": "Vakarian"}, {1: 2, 2: 4, 3: 8}, Record({chr(97 + i): i for i in range(26)}, type_name="TestType"),
    Record({0: 1, 1: "x"}, positional=True, variant_name="V", variant_id=3, type_hash=b"h" * 32), uuid.UUID(int=5), Nanos(-500_000_000), Digest(3, b"x" * 32), Unit("Redacted"), Unit("Unknown"),
]


@pytest.mark.parametrize("v", VALUES, ids=repr)
def test_round_trip(v):
    b = encode(v)
    assert len(b) % 8 == 0 and decode(b) == v and read(b)[2] == len(b)


def test_exact_bytes():
    assert encode(True) == bytes.fromhex("0000010001000000")
    assert encode(-1) == bytes.fromhex("00000200ffffffff")
    assert encode("hunter2") == bytes.fromhex("00090c0001000000") + b"hunter2\0"


def test_digest_has_no_padding():
    assert len(decode(encode(Digest(1, b"x" * 20))).digest) == 20


def test_names_have_at_most_255_bytes():
    assert decode(encode(Record({"n" * 255: 1}))).fields == {"n" * 255: 1}
    with pytest.raises(Malformed):
        encode(Record({"n" * 256: 1}))


json_like = st.recursive(st.none() | st.booleans() | st.integers(-(2**127), 2**127 - 1) | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(max_size=20), x), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(json_like)
def test_any_value(v):
    assert decode(encode(v)) == v


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80), st.integers(0, 200))
def test_malformed_bytes_raise_only_malformed(noise, cut):
    b = encode(Record({"a": [1, {"k": "v"}], "b": (1.5, None)}, type_name="T"))
    for x in (noise, b[:cut], b[: cut % len(b)] + noise):
        try:
            decode(x)
        except Malformed:
            pass


def test_files(spark, tmp_path):
    from marlstone.sources.value_files import read_values

    (tmp_path / "good").write_bytes(encode(1) + encode("two") + encode([3]))
    (tmp_path / "cut").write_bytes(encode("whole") + encode("cut")[:12])
    got = {(r.path.rsplit("/", 1)[-1], r.ordinal): (r.type, r.json, r.error is None) for r in read_values(spark, str(tmp_path)).collect()}
    assert got == {("good", 0): ("SignedInt", "1", True), ("good", 1): ("String", '"two"', True), ("good", 2): ("Vec", "[3]", True), ("cut", 0): ("String", '"whole"', True), ("cut", 1): (None, None, False)}


def test_values_written_are_read_back(spark, tmp_path):
    from pyspark.sql import functions as F

    from marlstone.sources.value_files import encoded, read_values, write_values

    path = str(tmp_path / "out")
    rows = spark.range(500).repartition(3).select(F.when(F.col("id") != 7, encoded(F.format_string('{"k": %d}', "id"))).alias("v"), F.lit(1).alias("other"))
    write_values(rows, "v", path, roll=2000)
    want = sorted([f'{{"k": {i}}}' for i in range(500) if i != 7] + ["null"])

    def back():
        return sorted(r.json for r in read_values(spark, path).where("error is null").collect())

    assert back() == want and spark.read.format("binaryFile").load(path).where("length > 2000").count() == 0
    write_values(rows.limit(0), "v", path)
    assert back() == want
    write_values(rows.where("v is null"), "v", path, "overwrite")
    assert back() == ["null"]
    with pytest.raises(Exception, match="not binary"):
        write_values(rows, "other", path)
    assert back() == ["null"]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    from pyspark.sql import functions as F

    from marlstone.sources.value_files import write_values

    rows = spark.range(10).repartition(2).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.lit(b"x")).alias("v"))
    with pytest.raises(Exception):
        write_values(rows, "v", str(tmp_path))
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith("_")]
