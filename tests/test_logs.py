"""Logs: what is live against plain sets, and how often rows are moved."""

from collections import Counter

from marlstone.operators import txlog
from marlstone.plans import registry


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_what_is_live(spark):
    said = [("t1", "a", 0, None), ("t1", "a", 0, None), ("t1", "b", 0, None), ("t1", "b", 0, None), ("t2", "a", 0, None), ("t2", "c", 0, None), ("t3", "c", 1, "t2"), ("t3", "c", 1, "t2"), ("t3", "b", 1, "t1"), ("t4", "z", 1, "t2"), ("t4", "a", 1, None), ("t4", "d", 0, None), ("t5", "a", 1, "t4")]
    log = txlog.build(spark.createDataFrame([(t, o, bool(x), s) for t, o, x, s in said], "tx_hash string, object_hash string, deletes boolean, source_tx string"))
    gone = {(o, s) for _, o, x, s in said if x}
    want = Counter((o, t) for t, o, x, _ in said if not x and (o, t) not in gone)
    assert Counter(map(tuple, txlog.live(log).collect())) == want


def test_adds_are_moved_once(spark, sf):
    """One shuffle of the changes for the adds, one for the deletes, one that brings deletes to what they name; none after hashes are taken."""
    for name, most in (("txlog_live", 3), ("txlog_adds", 1), ("txlog_deletes", 1), ("txlog_build", 1)):
        df = registry.queries()[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert exchanges(df) <= most
        assert "sha2" not in plan[plan.index("Exchange") :]


def test_lists_are_made_after_the_shuffle(spark, sf):
    """Lists made before it get no shorter and spill: nothing is aggregated where the lines are read."""
    for name in ("txlog_adds", "txlog_deletes", "txlog_build"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        made, read = plan.split("Exchange", 1)
        assert "collect_list" in made and "Aggregate" not in read
