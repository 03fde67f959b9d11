"""What the operators of this subpackage share: reading tables and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="marlstone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


_made: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder for one written intermediate table."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def made_so_far() -> int:
    return len(_made)


def drop_scratch(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Deletes intermediate tables made since a mark (see made_so_far), but for those to keep; returns how many went.

    Results that are still to be computed read these tables: call it once they have been written or read.
    """
    sc = spark.sparkContext
    gone = [p for p in _made[since:] if p not in keep]
    for p in gone:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(p)
    return len(gone)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, column: str, buckets: int) -> DataFrame:
    """df written once to the shared folder in buckets of column, and read back: joins on it leave these rows where they are.

    The catalog's entry is dropped at once; the files and what is returned stay.
    """
    spark, name = df.sparkSession, f"marlstone_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", scratch(spark, what)).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; its session hands Python at most about BATCH_BYTES at once, unless the user has chosen a size."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key, "64MB").lower() in ("64mb", "67108864b", "67108864"):
        conf.set(key, str(BATCH_BYTES))
    return df
