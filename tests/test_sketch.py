"""The sketch of distinct parts is one for the table."""

from marlstone.plans import registry


def test_no_sketch_for_each_part(spark, sf):
    plan = registry.queries()["approx_distinct"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "approx_count_distinct" in x and "keys=[l_partkey" in x]
