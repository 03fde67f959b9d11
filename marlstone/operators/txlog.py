"""Transaction logs: added and deleted object hashes of each transaction, replayed to what is live."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import primitives, sealing, values, wire
from ..functions.packed import TEXT, TEXTS, row


def build(changes: DataFrame, collection=None, parents: DataFrame | None = None, public_key=None) -> DataFrame:
    """tx_log rows from changes (tx_hash, object_hash, deletes boolean): sorted adds, and deletes naming the adding transaction.

    Changes with a boolean column extent list the extents apart from the values.
    collection and public_key are constants of the log (null if not given);
    parents (tx_hash, previous_tx) gives the transactions that come before one.
    """
    split = {"values": ~F.col("extent"), "extents": F.col("extent")} if "extent" in changes.columns else {"values": F.lit(True)}
    lists = []
    for name, here in split.items():
        lists.append(F.sort_array(F.collect_list(F.when(here & ~F.col("deletes"), F.col("object_hash")))).alias(f"{name}_added"))
        lists.append(F.sort_array(F.collect_list(F.when(here & F.col("deletes"), F.struct("object_hash", F.col("source_tx"))))).alias(f"{name}_deleted"))
    # dealt out first: lists get no shorter by grouping before the shuffle, and a hash aggregate of lists sorts all of a task's rows for that
    log = changes.repartition("tx_hash").groupBy("tx_hash").agg(*lists)
    if parents is not None:
        before = parents.where("previous_tx is not null").groupBy("tx_hash").agg(F.sort_array(F.collect_set("previous_tx")).alias("previous_txs"))
        log = log.join(before, "tx_hash", "left").withColumn("previous_txs", F.coalesce("previous_txs", F.array().cast("array<string>")))
    for name, value in (("collection", collection), ("public_key", public_key)):
        if value is not None:
            log = log.withColumn(name, value)
    return log


@F.pandas_udf(T.BinaryType())
def _encoded(t: pd.DataFrame) -> pd.Series:
    raw = bytes.fromhex
    pairs = lambda x: tuple((raw(d["object_hash"]), raw(d["source_tx"])) for d in x)
    out = []
    for r in t.itertuples(index=False):
        parts = wire.Transaction(
            raw(r.collection), primitives.ed25519_public(bytes(r.seed)), tuple(map(raw, r.previous_txs)), tuple(map(raw, r.values_added)), pairs(r.values_deleted),
            tuple(map(raw, r.extents_added)), pairs(r.extents_deleted),
        )
        out.append(wire.encode(replace(parts, signature=primitives.ed25519_sign(bytes(r.seed), parts.covered()))))
    return pd.Series(out, dtype=object)


def encoded(log: DataFrame, seed) -> Column:
    """The binary form of each transaction of a log with collection, previous_txs and extents, signed by the key of a seed."""
    names = ["collection", "previous_txs", "values_added", "values_deleted", "extents_added", "extents_deleted"]
    return _encoded(F.struct(*names, seed.alias("seed")))


_DELETES = T.ArrayType(row(object_hash=TEXT, source_tx=TEXT))
READ = row(collection=TEXT, public_key=TEXT, previous_txs=TEXTS, values_added=TEXTS, values_deleted=_DELETES, extents_added=TEXTS, extents_deleted=_DELETES, sig_valid=T.BooleanType())


@F.pandas_udf(READ)
def _read(s: pd.Series) -> pd.DataFrame:
    names = ["collection", "public_key", "previous_txs", "values_added", "values_deleted", "extents_added", "extents_deleted", "sig_valid"]
    hexes = lambda x: [h.hex() for h in x]
    pairs = lambda x: [{"object_hash": a.hex(), "source_tx": b.hex()} for a, b in x]
    rows = []
    for b in s:
        try:
            t = None if b is None else wire.decode(bytes(b))
        except wire.Malformed:
            t = None
        if isinstance(t, wire.Transaction):
            good = primitives.ed25519_valid(t.public_key, t.covered(), t.signature)
            rows.append((t.collection.hex(), t.public_key.hex(), hexes(t.previous), hexes(t.added), pairs(t.deleted), hexes(t.extents_added), pairs(t.extents_deleted), good))
        else:
            rows.append((None,) * 8)
    return pd.DataFrame(rows, columns=names)


def decoded(b) -> Column:
    """All fields of a transaction's binary form, and whether its signature holds; nulls for anything else."""
    return _read(values.col(b))


def _signed_part(log: DataFrame) -> Column:
    """All of a transaction but its signature, as bytes; columns by name."""
    return F.encode(F.to_json(F.struct(*sorted(c for c in log.columns if c not in ("signature", "sig_valid"))), {"ignoreNullFields": "false"}), "UTF-8")


def signed(log: DataFrame, seed) -> DataFrame:
    """The log with a signature of everything else in each transaction."""
    return log.withColumn("signature", sealing.signed(_signed_part(log), seed))


def checked(log: DataFrame) -> DataFrame:
    """The log with sig_valid; a transaction whose signature does not hold is flagged and kept."""
    return log.withColumn("sig_valid", sealing.signer(_signed_part(log), "signature").isNotNull())


def adds(log: DataFrame) -> DataFrame:
    return log.select(F.explode("values_added").alias("object_hash"), "tx_hash")


def deletes(log: DataFrame) -> DataFrame:
    return log.select(F.explode("values_deleted").alias("d"), "tx_hash").select("d.object_hash", "d.source_tx", "tx_hash")


def extent_adds(log: DataFrame) -> DataFrame:
    return log.select(F.explode("extents_added").alias("object_hash"), "tx_hash")


def extent_deletes(log: DataFrame) -> DataFrame:
    return log.select(F.explode("extents_deleted").alias("d"), "tx_hash").select("d.object_hash", "d.source_tx", "tx_hash")


def live(log: DataFrame) -> DataFrame:
    """What was added and not deleted: a delete removes the add of the transaction it names, and no other.

    Deletes come to where the log has the transaction they name, so adds are not moved again.
    """
    named = deletes(log).select("object_hash", F.col("source_tx").alias("tx_hash")).where("tx_hash is not null").repartition("tx_hash")
    gone = named.groupBy("tx_hash").agg(F.collect_set("object_hash").alias("gone"))
    added = F.col("values_added")
    # array_except gives each object once, in linear time: what a transaction adds twice is looked up instead
    once = F.size(F.array_distinct(added)) == F.size(added)
    left = F.when(F.col("gone").isNull(), added).when(once, F.array_except(added, "gone")).otherwise(F.filter(added, lambda x: ~F.array_contains("gone", x)))
    return log.select("tx_hash", "values_added").join(gone, "tx_hash", "left").select(F.explode(left).alias("object_hash"), "tx_hash")


def heads(log: DataFrame) -> DataFrame:
    """Transactions that no other lists as previous."""
    return log.join(log.select(F.explode("previous_txs").alias("tx_hash")), "tx_hash", "left_anti")
