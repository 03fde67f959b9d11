"""Row numbers of a total order, without moving all rows to one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder for checkpoints: spark.checkpoint.dir; a folder of this machine only where that is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlstone-"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over spark.sql.shuffle.partitions tasks, for work that is costly by row: a small file is a single task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def row_numbers(df: DataFrame, order: list, name: str = "rn", costly: bool = False) -> DataFrame:
    """df with its 1-based place in the order.

    Rows are dealt by ranges of the order and sorted inside them; a checkpoint
    fixes that, and each range then starts after the rows of those before it.
    Dealing by ranges reads df twice, for a sample and for the rows; with costly
    it is written first, so that what it takes to make df is done once.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    df = df.checkpoint() if costly else df
    keys = [f"__k{i}" for i in range(len(order))]
    keyed = df.select("*", *[(F.expr(o.rsplit(" ", 1)[0]) if o.endswith((" desc", " asc")) else F.expr(o)).alias(k) for o, k in zip(order, keys)])
    by = [F.col(k).desc_nulls_last() if o.endswith(" desc") else F.col(k).asc_nulls_first() for o, k in zip(order, keys)]
    sealed = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(*df.columns, F.monotonically_increasing_id().alias("__at")).checkpoint()
    part = F.shiftright("__at", 33)
    counts = sorted((r["p"], r["n"]) for r in sealed.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect())  # a row for each partition
    starts, total = [], 0
    for p, n in counts:
        starts += [F.lit(p), F.lit(total).cast("long")]
        total += n
    before = F.element_at(F.create_map(*starts), part) if starts else F.lit(0).cast("long")
    return sealed.select(*df.columns, (before + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
