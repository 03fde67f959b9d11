"""SimHash near-dedup: fingerprints, BK-trees over shards of fingerprints, components.

A BK-tree keeps each fingerprint below its parent under the integer Hamming
distance between them; a search within radius r follows only the edges whose
distance lies in [d - r, d + r].  One tree over everything would visit most of
its nodes and would have to be broadcast whole, so the distinct fingerprints
are sharded first: their 64 bits are cut into bands, and two fingerprints
within r bits agree on at least (bands - r) of them, so each pair meets in a
shard of equal bits.  A shard's tree is built where its rows are.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, materialise, table
from .graph import components

WORDS, RADIUS, SEED = 4, 4, 42


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes (repeats count)."""
    toks = (text or "").encode().lower().split()
    if not toks:
        return 0
    if len(toks) <= words:
        return xxhash.xxh64_intdigest(b" ".join(toks), seed=SEED)
    joined = b" ".join(toks)
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(toks) - words + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(starts)
    stops = (ends[words - 1 :] - 1).tolist()
    for at in range(0, n, 1 << 16):  # so many shingles at once, for bounded memory
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], dtype=">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.int64 if len(h) < 256 else np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


class BKTree:
    """Fingerprints below their parent by integer Hamming distance, each with a value.

    A node is [fingerprint, value, children, label]: the label is a value of the
    subtree's while all its values are of one class, None once they may not be.
    """

    def __init__(self):
        self.root = None

    def add(self, fp: int, value, same=lambda a, b: False) -> None:
        """same(a, b) says whether two values are of one class; classes may merge later, but not split."""
        node = [fp, value, {}, value]
        if self.root is None:
            self.root = node
            return
        at = self.root
        while True:
            if at[3] is None:  # what was apart may have been joined since
                if same(at[1], value) and all(x[3] is not None and same(x[3], value) for x in at[2].values()):
                    at[3] = value
            elif not same(at[3], value):
                at[3] = None
            d = (at[0] ^ fp).bit_count()
            below = at[2].get(d)
            if below is None:
                at[2][d] = node
                return
            at = below

    def within(self, fp: int, radius: int, known=lambda label: False):
        """Values within the radius, but for subtrees of one class that is known by the time the search gets there."""
        todo = [self.root] if self.root else []
        while todo:
            at = todo.pop()
            if at[3] is not None and known(at[3]):
                continue
            d = (at[0] ^ fp).bit_count()
            if d <= radius:
                yield at[1]
            for k, below in at[2].items():
                if d - radius <= k <= d + radius:
                    todo.append(below)


def shard_links(fps: list[int], ids: Sequence, radius: int) -> list[tuple]:
    """A spanning forest of the links within one shard: no two texts that link are parted, no clique is spelt out.

    A search leaves out subtrees whose fingerprints are all in the searcher's
    component already, so a large group of near copies costs a few steps each.
    """
    if len(fps) == 2:
        return [(ids[0], ids[1])] if (fps[0] ^ fps[1]).bit_count() <= radius else []
    tree, up, out = BKTree(), list(range(len(fps))), []

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def same(i, j):
        return top(i) == top(j)

    for i, fp in enumerate(fps):
        for j in tree.within(fp, radius, lambda label: same(label, i)):
            a, b = top(i), top(j)
            if a != b:
                up[a] = b
                out.append((ids[i], ids[j]))
        tree.add(fp, i, same)
    return out


def bands(distinct: int, radius: int) -> list[int]:
    """Masks of the bits on which a pair must agree in at least one case; more bands as there are more fingerprints."""
    n = radius + 1
    while 2 ** (64 * (n - radius) / n) * 4 < distinct and n < 2 * radius:
        n += 1
    n = max(n, radius + 2)
    edges = [round(64 * k / n) for k in range(n + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(parts, n - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of docs (doc_id, text); null text counts as empty."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


def link_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and component_id for the fingerprints (doc_id, fp): the smallest doc_id reachable over links of <= radius bits.

    Copies of a fingerprint are one vertex, named by its smallest doc_id.
    """
    vertex = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("vid")), "simhash-vertices")
    named = vertex.where("vid is not null")
    masks = [_signed(m) for m in bands(named.count(), radius)]
    keyed = named.select(
        "fp", "vid",
        F.explode(F.array(*[F.struct(F.lit(k).alias("shard"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])).alias("k"),
    ).select("k.shard", "k.bits", "fp", "vid")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of a shard come together and in order; only shards of two and more reach a tree
    dealt = keyed.repartition(n, "shard", "bits").sortWithinPartitions("shard", "bits", "fp")

    def run(batches):
        held = None  # the rows of the shard that may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            shard, bits = (t[c].to_numpy() for c in ("shard", "bits"))
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (bits[1:] != bits[:-1])) + 1
            yield from links(t, cut)
            held = t.slice(cut[-1] if len(cut) else 0)
        if held is not None:
            yield from links(held, np.array([held.num_rows]))

    def links(t, cut):
        fps, out = t["fp"].to_numpy().view(np.uint64), []
        for a, z in zip([0, *cut[:-1].tolist()], cut.tolist()):
            if z - a > 1:
                out += shard_links(fps[a:z].tolist(), range(a, z), radius)
        if out:
            ab = np.array(out, np.int64)
            vid = t["vid"].combine_chunks()
            yield pa.RecordBatch.from_arrays([vid.take(pa.array(ab[:, 0])), vid.take(pa.array(ab[:, 1]))], ["a", "b"])

    id_type = fps.schema["doc_id"].dataType.simpleString()
    linked = components(dealt.mapInArrow(run, f"a {id_type}, b {id_type}"), "simhash-links")
    return vertex.join(linked.withColumnRenamed("node", "vid"), "vid", "left").select("fp", F.coalesce("root", "vid").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other; ties
    and repeated rows share a component; a null doc_id gets its text's
    component, which is null if no row of it has a doc_id.  Whole texts of any
    length are used.  Extra columns are ignored; an empty table gives none.
    """
    fps = materialise(fingerprints(docs), "simhash-fingerprints")
    return fps.join(link_components(fps, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stand for their component (the smallest doc_id), with all columns.

    doc_id names a document: rows that share one go only if none of them stands
    for its component.  Rows without a doc_id stay.
    """
    named = near_duplicates(docs, radius).where("doc_id is not null")
    gone = named.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stands")).where("not stands").select("doc_id")
    return docs.join(materialise(gone, "simhash-dropped"), "doc_id", "left_anti").select(docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
