import random

import pytest
from pyspark.sql import types as T

#: Other columns of clashing names, as a table may bring them.
EXTRA = ["block", "part", "fp", "ids", "vid", "k", "g", "held_out", "kept", "rest", "raw", "turns", "fold", "score", "component_id"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA]
)


def edge_rows():
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(120)
    texts = {
        0: None, 1: "", 2: " \t\n", 3: "a", 4: "Hello, World!", 5: base, 6: base, 7: base + " tail", 8: "x" + base[1:], 9: prose(20_000), 10: "a" * 3000, 11: "漢字かな交じり文 😀 <|endoftext|> done", 12: "12 34 !!",
        13: "İstanbul ΣΑΣ   \x1c \x00 é é", 14: prose(3), 15: prose(4), 16: "the the the the the", 17: "The THE the tHe the", 18: base.upper(), 19: prose(60) + " " + base[:400] + " " + prose(60),
    }
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i}", None if t is None else len(t)) for i, t in texts.items()]
    rows += [rows[5], rows[5], (None, base, "en", None, 3), (None, None, None, None, None)]
    return [(*row, *[f"clash{i}"] * len(EXTRA)) for i, row in enumerate(rows)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
