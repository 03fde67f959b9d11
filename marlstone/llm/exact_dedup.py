"""Exact dedup against a persistent digest index.

The index is a table of digests, bucketed and sorted by the digest. New data is
deduplicated inside itself by a partial aggregation, then against the index by a
sort-merge anti-join, and what is new is appended.  DataFrame expressions only.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, shared_dir, table

BUCKETS = 32  # of a new index, at least; as many as the session's shuffle partitions if those are more


class DigestIndex:
    """Digests already seen: (text_sha256, keep_id, group_size, load), bucketed and sorted by text_sha256.

    The files live at ``location`` and outlive the session; opening the same
    location again finds them, with the number of buckets and the type of
    keep_id they were made with, which a one-row table beside them keeps.  The
    catalog holds nothing between calls.

    One loader appends at a time.  Should two append at once all the same, a
    digest that both bring stands there twice, and its rows come back once for
    each, until ``compacted`` has left only the one of the lowest load name.
    """

    COLUMNS = ["text_sha256", "keep_id", "group_size", "load"]

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.location = spark, location.rstrip("/")
        self.buckets, self.id_type = self._layout(buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))), id_type)

    def _layout(self, buckets: int, id_type: str) -> tuple[int, str]:
        at, schema = f"{self.location}.layout", "buckets int, id_type string"
        try:
            found = self.spark.read.schema(schema).parquet(at).first()
            return found["buckets"], found["id_type"] or "bigint"
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        self.spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type")).coalesce(1).write.parquet(at)
        return buckets, id_type

    @contextmanager
    def _attached(self):
        """The name of a catalog table over the files, gone again afterwards; the files stay."""
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (text_sha256 STRING, keep_id {self.id_type}, group_size BIGINT, load STRING) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def read(self) -> DataFrame:
        """The bucketed table: joins on the digest with as many partitions need no shuffle of it."""
        with self._attached() as name:
            return self.spark.table(name)

    def files(self) -> DataFrame:
        """The same rows without the bucketing, for joins with rows of which many may share a digest: AQE can split what it shuffles itself."""
        return self.spark.read.schema(f"text_sha256 string, keep_id {self.id_type}, group_size bigint, load string").parquet(self.location)

    def add(self, digests: DataFrame) -> str:
        """Append the digests (text_sha256, keep_id, group_size) that the index does not hold yet; returns the load's name."""
        load = uuid.uuid4().hex
        # written first: the optimiser would move the anti-join below the aggregation, to where a hot digest still has all its rows
        digests = materialise(digests, "digests")
        new = digests.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        self._write(new.select("text_sha256", "keep_id", "group_size", F.lit(load).alias("load")).repartition(self.buckets, "text_sha256"))
        return load

    def _write(self, rows: DataFrame) -> None:
        """Append rows that are partitioned by bucket: one sorted file for each bucket that gets some."""
        with self._attached() as name:
            (
                rows.select(self.COLUMNS).write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
                .option("path", self.location).saveAsTable(name)
            )

    def compacted(self, location: str) -> DigestIndex:
        """A new index at another location with the same digests, each once, in one sorted file a bucket; no row is shuffled."""
        out = DigestIndex(self.spark, location, self.buckets, self.id_type)
        out._write(self.read().groupBy("text_sha256").agg(F.min_by(F.struct("keep_id", "group_size", "load"), "load").alias("first")).select("text_sha256", "first.*"))
        return out


def digested(docs: DataFrame, normalise=None) -> DataFrame:
    """doc_id and the SHA-256 of the text (null counts as empty), in lowercase hex."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.sha2((normalise(text) if normalise else text).cast("binary"), 256).alias("text_sha256"))


def group_digests(hashed: DataFrame) -> DataFrame:
    """One row for each digest; map-side partial aggregation makes a hot digest one row a task."""
    return hashed.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def deduplicate(docs: DataFrame, index: DigestIndex, normalise=None) -> DataFrame:
    """Deduplicate docs (doc_id, text) against the index and within themselves, and append what is new.

    Returns one row for each input row: doc_id, keep_id (the row of this text
    that stays: the one the index holds, else the largest doc_id), group_size
    (rows of this text in the load that first brought it), kept, text_sha256.
    A null text counts as empty.  Repeated rows of one doc_id and text are one
    document said twice: both report the same keep_id and count in group_size.
    A null doc_id never wins over another one; if all doc_ids of a text are
    null, keep_id is null and all of them are kept.  Extra columns are ignored;
    an empty table gives no rows.
    """
    hashed = digested(docs, normalise)
    index.add(group_digests(hashed))
    # The hot side is split by AQE's skew join: every row meets one index row.
    return hashed.join(index.files().hint("merge"), "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256",
    )


def keep_first_seen(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that stay, with all columns; the index learns the new digests.

    Of equal texts the row with the largest doc_id stays, and of repeated rows
    of that doc_id one.  A null text counts as empty; if all doc_ids of a text
    are null, one of its rows stays.  An empty table gives none.  Rows meet the
    index by digest and doc_id together, so a text that a third of the rows
    share is dealt over all tasks, and repeated rows fall away where they lie:
    whole rows move once.
    """
    load = index.add(group_digests(digested(docs)))
    id_key = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("__id"), F.col(c).isNull().alias("__none")]
    fresh = index.files().where(F.col("load") == load).select(F.col("text_sha256").alias("__digest"), *id_key("keep_id"))
    marked = docs.select("*", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("__digest"), *id_key("doc_id"))
    keys = ["__digest", "__id", "__none"]
    return marked.join(fresh.hint("merge"), keys, "left_semi").dropDuplicates(keys).select(docs.columns)


def new_index(spark: SparkSession, location: str | None = None, id_type: str = "bigint") -> DigestIndex:
    return DigestIndex(spark, location or f"{shared_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}", id_type=id_type)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduplicate(docs, new_index(spark, id_type=docs.schema["doc_id"].dataType.simpleString()))


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
