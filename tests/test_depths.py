"""Depths: parents outside, several heads, and rounds that move numbers instead of hashes."""

from marlstone.operators import documents as D


def test_depths_move_numbers(spark):
    said = [("a", []), ("b", ["a"]), ("c", ["b", "a"]), ("d", ["b"]), ("x", ["outside"]), ("y", ["x"])]
    docs = spark.createDataFrame([(h, [(p, "t") for p in up]) for h, up in said], "doc_hash string, prev_versions array<struct<document: string, from_tx: string>>")
    out = D.depths(docs)
    assert {r.doc_hash: r.depth for r in out.collect()} == {"a": 0, "b": 1, "c": 2, "d": 2, "x": 1, "y": 2}
    assert "doc_hash#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "Join Inner, (n#" in plan
