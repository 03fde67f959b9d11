"""Versioned documents: rows with an id, a body, a content hash and the versions they replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import col
from .ranking import ensure_checkpoint_dir


def version(document, from_tx) -> Column:
    """A reference to a version: the document's hash and the transaction that brought it."""
    return F.struct(col(document).alias("document"), col(from_tx).alias("from_tx"))


NONE = "array<struct<document: string, from_tx: string>>"


def new(rows: DataFrame, doc_id: str, body: str) -> DataFrame:
    """Documents without a history: id, body, doc_hash, prev_versions."""
    return _hashed(rows.select(F.col(doc_id).alias("id"), F.col(body).alias("body"), F.array().cast(NONE).alias("prev_versions")))


def replace(rows: DataFrame, doc_id: str, body: str, replaces: str) -> DataFrame:
    """Documents that take the place of the versions in a column of references, of which there are 65535 at most."""
    many = F.size(replaces) > 65535
    checked = F.when(many, F.raise_error(F.lit("documents replace at most 65535 versions")).cast(NONE)).otherwise(F.col(replaces))
    return _hashed(rows.select(F.col(doc_id).alias("id"), F.col(body).alias("body"), checked.alias("prev_versions")))


def update(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions of documents from changes (doc_hash of the parent, body, from_tx): the parent's id, the new body, the parent replaced.

    A change whose parent is not among docs gives no row; null bodies are bodies.
    """
    parents = docs.select("doc_hash", "id")
    said = changes.select("doc_hash", F.col("body").alias("body"), "from_tx")
    return _hashed(parents.join(said, "doc_hash").select("id", "body", F.array(version("doc_hash", "from_tx")).alias("prev_versions")))


def with_body(docs: DataFrame, body) -> DataFrame:
    """The documents with another body and the hash that goes with it."""
    return _hashed(docs.withColumn("body", body))


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with doc_hash: of id, body and the versions replaced."""
    return docs.withColumn("doc_hash", F.sha2(F.to_json(F.struct("id", "body", "prev_versions")), 256))


def history(rows: DataFrame, doc_id: str, body: str, order: list[str], merge_every: int = 10) -> DataFrame:
    """Documents from a change log: each row replaces the one before it of its id.

    A row whose last order column is a multiple of merge_every also replaces
    the one before that, as a merge does.  A version's transaction is named by
    the hash of its row's last order column.
    """
    w = Window.partitionBy(doc_id).orderBy(*order)
    hashed = rows.withColumn("doc_hash", F.sha2(F.concat_ws("|", doc_id, *order[-1:], body), 256)).withColumn("from_tx", F.sha2(F.concat(F.lit("tx|"), F.col(order[-1]).cast("string")), 256))
    ref = version("doc_hash", "from_tx")
    prev = F.array_compact(F.array(F.lag(ref).over(w), F.when(F.col(order[-1]) % merge_every == 0, F.lag(ref, 2).over(w))))
    return hashed.select(F.col(doc_id).alias("id"), F.col(body).alias("body"), F.col(order[-1]).alias("seq"), "doc_hash", "from_tx", prev.alias("prev_versions"))


def renamed(docs: DataFrame, new_id) -> DataFrame:
    """A rename starts a history of its own."""
    return docs.withColumn("id", new_id).withColumn("prev_versions", F.array().cast(NONE))


def heads(docs: DataFrame) -> DataFrame:
    """Versions that nothing replaces."""
    replaced = docs.select(F.explode("prev_versions.document").alias("doc_hash"))
    return docs.join(replaced, "doc_hash", "left_anti")


def merges(docs: DataFrame) -> DataFrame:
    return docs.where(F.size("prev_versions") >= 2)


def depths(docs: DataFrame) -> DataFrame:
    """doc_hash and depth along first parents, by pointer doubling: rounds grow with the logarithm of the longest chain.

    Hashes are read twice only: versions are numbered, a join turns parents into
    numbers, and rounds move numbers; the last join brings the hashes back.
    Only versions whose chain is not yet at its end take part in a round; those
    that have arrived are set aside.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = docs.select("doc_hash", F.get("prev_versions.document", F.lit(0)).alias("above"), F.when(F.size("prev_versions") > 0, 1).otherwise(0).cast("long").alias("depth"))
    # a checkpoint fixes the numbers, which depend on how rows lie in partitions
    kept = kept.withColumn("n", F.monotonically_increasing_id()).checkpoint()
    named = kept.select(F.col("doc_hash").alias("above"), F.col("n").alias("up"))
    # a parent that is not among docs ends a chain, after the step that leads to it
    at = kept.where("above is not null").select("n", "above", "depth").join(named, "above", "left").select("n", "up", "depth").checkpoint()
    done = kept.where("above is null").select("n", "depth").unionByName(at.where("up is null").select("n", "depth"))
    while True:
        way = at.where("up is not null")
        if not way.take(1):
            return kept.select("doc_hash", "n").join(done, "n").select("doc_hash", "depth")
        known = way.unionByName(done.withColumn("up", F.lit(None).cast("long")))
        above = known.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        at = way.join(above, "up", "left").select("n", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")).checkpoint()
        # a union adds up partitions, of which the later rounds' hold little
        done = done.unionByName(at.where("up is null").select("n", "depth")).coalesce(parts)
