"""Queries of vectors read every element."""

from pyspark.sql import functions as F

from marlstone.plans import registry


def test_whole_vectors_are_ordered_and_summed(spark, tmp_path):
    head = [0.25] * 63
    data = [(1, [*head, 0.5]), (2, [*head, -0.5]), (3, [-0.125, *head]), (4, head), (5, [*head, -0.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("label", F.lit(0))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    q = registry.queries()
    assert {r.vec_id: r.rn for r in q["sort_vec_whole"](spark, str(tmp_path)).collect()} == {3: 1, 4: 2, 2: 3, 5: 4, 1: 5}
    assert {r.vec_id: r.total for r in q["seq_from_any_micros"](spark, str(tmp_path)).collect()} == {i: int(sum(v) * 1_000_000) for i, v in data}
