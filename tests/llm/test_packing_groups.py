"""Groups of packing stay bounded where rows have no doc_id or one."""

from collections import Counter

from marlstone.llm import packing


def test_null_and_repeated_ids_spread_over_groups(spark):
    docs = spark.range(1200).selectExpr("CASE WHEN id % 3 = 0 THEN id WHEN id % 3 = 1 THEN 7 END AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the same' ELSE concat('text ', id) END AS text").repartition(4)
    got = packing.pack(docs, group=100).collect()
    rows = Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 1200 and len(rows) == 12 and max(rows.values()) < 200
