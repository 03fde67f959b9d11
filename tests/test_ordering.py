"""The order over kinds: keys against comparisons written out, and the byte order of the binary form."""

import itertools
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone.functions import ordering as O, values as V, wire
from marlstone.sources.value_files import encoded

TEXTS = ["", "_", "1", "a", "A", "b", "B", "é", "Garrus Vakarian", "Jane Shepard", "z"]  # in root collation order
NUMBERS = ["-1e400", "-12345678901234567891", "-9007199254740993", "-9007199254740992", "-10", "-9.5", "-9", "-0.25", "0", "0.0009", "0.001", "1", "1.5", "2", "9", "10", "999", "1e3", "1000.5", "9007199254740992", "9007199254740992.5", "9007199254740993", "12345678901234567890", "12345678901234567891", "1e40", "1e400"]
LISTS = ["[]", "[null]", "[false]", "[1]", "[1,9]", "[1,10]", "[1,10,0]", "[2]", "[[]]", "[[1],2]", "[[1,0]]", '["a"]', '["A"]', '["B"]']
RECORDS = ["{}", '{"a":1}', '{"a":1,"b":1}', '{"a":2}', '{"aa":0}', '{"b":0}', '{"b":[1]}', '{"b":{"c":1}}', '{"b":"x"}']
WANT = ["null", "false", "true", *NUMBERS, *LISTS, *RECORDS, *[json.dumps(t, ensure_ascii=False) for t in TEXTS]]


def test_the_order_over_all_kinds(spark):
    said = list(enumerate([*WANT, "{bad"]))
    random.Random(3).shuffle(said)
    df = spark.createDataFrame(said, "i int, j string").repartition(5)
    assert [r.i for r in df.orderBy(O.order_key("j"), "i").collect()] == list(range(len(said)))


def test_equal_values_have_equal_keys(spark):
    same = [("1", "1.0"), ("1e3", "1000"), ('"é"', '"é"'), ("[1,2]", "[ 1.0 , 2 ]"), ('{"a":1,"b":2}', '{"b":2,"a":1}'), ("0", "-0")]
    df = spark.createDataFrame(same, "a string, b string")
    assert all(r.c == 0 for r in df.select(O.compared(O.order_key("a"), O.order_key("b")).alias("c")).collect())


def test_number_keys_are_the_decimals_order(spark):
    r = random.Random(5)
    texts = list({f"{r.choice(['', '-'])}{r.randint(0, 10 ** r.randint(0, 36))}{r.choice(['', f'.{r.randint(0, 10 ** 6)}'])}" for _ in range(800)} - {"-0"})
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", O.number_key("t").alias("k")).collect()
    by = sorted(got, key=lambda x: x.k)
    assert all(Decimal(a.t) <= Decimal(b.t) and (Decimal(a.t) == Decimal(b.t)) == (a.k == b.k) for a, b in itertools.pairwise(by) if "-0" not in (a.t[:2], b.t[:2]) or Decimal(a.t) or Decimal(b.t))


def test_floats_in_their_total_order(spark):
    want = ["-Infinity", "-1.0E300", "-4.9E-324", "-0.0", "0.0", "4.9E-324", "1.0E300", "Infinity", "NaN"]
    df = spark.createDataFrame([(i, float(t.replace("Infinity", "inf"))) for i, t in enumerate(want)], "i int, x double")
    assert [r.i for r in df.orderBy(O.number_key(F.col("x").cast("string"))).collect()] == list(range(len(want)))


def test_byte_order_is_that_of_type_and_content(spark):
    js = ["null", "true", "1", "-1", "256", "1.5", '"b"', '"a"', "[1]", '{"a":1}', "9007199254740993", "{bad"]
    key = lambda j: None if j == "{bad" else (lambda b: b[2:4] + wire.read(b)[1])(wire.encode(wire.Record(json.loads(j)) if j[0] == "{" else json.loads(j)))
    got = spark.createDataFrame([(j,) for j in js], "j string").select("j", O.order_key("j", "bytes").alias("k")).collect()
    assert all((None if r.k is None else bytes(r.k)) == key(r.j) for r in got)
    with pytest.raises(ValueError):
        O.order_key("j", "other")


def test_wide_integers_are_integers(spark):
    js = [("9223372036854775807", "SignedInt"), ("9223372036854775808", "UnsignedInt"), ("-9223372036854775809", "SignedInt"), ("1000000000000000000", "SignedInt"), ("1.5", "Float"), ("1e3", "Float")]
    got = spark.createDataFrame(js, "j string, want string").select("want", V.kind(V.parsed("j")).alias("k"), V.typed(V.parsed("j"), "UnsignedInt").alias("u")).collect()
    assert all(r.k == r.want and (r.u is not None) == (r.k == "UnsignedInt") for r in got)


def test_arrays_in_order(spark):
    df = spark.createDataFrame([([2, 1],), ([],), ([5],)], "a array<int>")
    assert [r.s for r in df.select(O.ordered("a").alias("s")).collect()] == [[1, 2], [], [5]]
    assert [r.s for r in df.select(O.ordered("a", assume=True).alias("s")).collect()] == [[2, 1], [], [5]]
    assert df.select(encoded(F.lit("[1]")).alias("b")).first().b is not None
