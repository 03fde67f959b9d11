"""LM scoring by deleted interpolation.

Maximum-likelihood estimates of two orders and a uniform floor are mixed with
weights that depend on how often the context was seen (buckets by powers of
two).  The weights are learned by expectation-maximisation on the counts of a
held-out tenth of the training documents, whose own counts are deleted from
the estimates meanwhile; the estimates themselves are made alike there and in
scoring.

Counts cover the whole corpus.  Blocks of documents ask for the counts of their
distinct words and word pairs; each partition of keys adds up what all blocks
report and answers each block.  The blocks themselves stay in the files of their
buckets: only keys, counts and answers move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .blocks import arrow_blocks, buckets_of, dealt, numbers_in_bucket, rows_of, squeeze, thick, thin, unsqueeze
from .common import bounded_batches, bucketed, materialise, table

ALPHA = 0.1  # of the smoothed unigram
FOLDS, TEST_FOLD, EM_FOLD = 10, 0, 1
PAIR_BYTES = 6  # of a word pair's key inside its partition; a word's has all 8
BLOCK = 8 << 20
EM_ROUNDS = 40
STEPS = 4  # of an octave, in the grid that EM reads


def _mix(v: np.ndarray, w: np.ndarray, n_parts: int) -> np.ndarray:
    """A key of a word pair: of as many bits as leave PAIR_BYTES when it is divided by the number of partitions."""
    k = v * np.uint64(0x9E3779B97F4A7C15) + ((w << np.uint64(31)) | (w >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    k ^= k >> np.uint64(32)
    k *= np.uint64(0xD6E8FEB86659FD93)
    return k >> np.uint64(max(0, 64 - 8 * PAIR_BYTES - (n_parts.bit_length() - 1)))


def _keys(block, n_parts: int):
    """What a block asks: words' keys, its distinct pairs, their keys, and each token's place among them; with the order of dealing."""
    words = unsqueeze(block["words"], "<u8")
    ids = unsqueeze(block["ids"], "<u4").astype(np.int64)
    before = np.concatenate(([0], ids[:-1]))  # word 0 is the end, which also stands before a text
    pairs, at = np.unique(before * len(words) + ids, return_inverse=True)
    keys = _mix(words[pairs // len(words)], words[pairs % len(words)], n_parts)
    w_parts, p_parts = words % np.uint64(n_parts), keys % np.uint64(n_parts)
    return words, ids, before, keys, at, dealt(w_parts, n_parts), dealt(p_parts, n_parts)


BLOCK_SCHEMA = "block long, em boolean, rest binary, folds binary, lens binary, ids binary, words binary"


def token_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks: doc ids, folds, lengths; each token's number in the block; the block's distinct words as hashes.

    A block that has held-out texts brings them once more by themselves (em), to
    be asked about and not counted.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("byte")

    def run(batches):
        from pyspark import TaskContext

        numbers = numbers_in_bucket(TaskContext.get().partitionId(), buckets)  # a task writes one file
        for _, rest, texts in arrow_blocks(batches, limit=BLOCK):
            seen, ids, lens = {b"": 0}, [], []
            for t in texts:
                toks = t.lower().split()  # ASCII letters and white space only, on bytes
                ids += [seen.setdefault(w, len(seen)) for w in toks]
                ids.append(0)
                lens.append(len(toks) + 1)
            texts.clear()
            words = np.array([xxhash.xxh64_intdigest(w) for w in seen], "<u8")
            del seen
            ids, lens, folds = np.array(ids, "<u4"), np.array(lens, np.int64), rows_of(rest)["fold"].to_numpy()
            out = [(next(numbers), False, rest, squeeze(folds), squeeze(lens), squeeze(ids), squeeze(words))]
            if (folds == EM_FOLD).any():
                used, own = np.unique(np.concatenate(([0], ids[np.repeat(folds == EM_FOLD, lens)])), return_inverse=True)
                out.append((next(numbers), True, b"", squeeze(b""), squeeze(b""), squeeze(own[1:].astype("<u4")), squeeze(words[used])))
            kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["block", "em", "rest", "folds", "lens", "ids", "words"])

    return bounded_batches(docs).select("doc_id", fold.alias("fold"), "text").mapInArrow(run, BLOCK_SCHEMA)


def count_service(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, em, part, ...): for each block and partition of keys the corpus counts of what the block has there.

    Per key: its count in training, and in the fold that EM holds out.  The rows
    with a null block hold the partition's totals: words known, tokens, tokens held out.
    """

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                words, ids, _, keys, at, (wo, wb), (po, pb) = _keys(row, parts)
                folds = np.repeat(unsqueeze(row["folds"], np.int8), unsqueeze(row["lens"], np.int64)) if not row["em"] else np.full(len(ids), -1)
                train, em = (folds >= 0) & (folds != TEST_FOLD), folds == EM_FOLD
                cw = [np.bincount(ids[m], minlength=len(words)).astype("<u4")[wo] for m in (train, em)]
                cp = [np.bincount(at[m], minlength=len(keys)).astype("<u4")[po] for m in (train, em)]
                words, keys = words[wo], keys[po] // np.uint64(parts)
                out = []
                for p in range(parts):
                    w, k = slice(wb[p], wb[p + 1]), slice(pb[p], pb[p + 1])
                    if w.start < w.stop or k.start < k.stop:
                        out.append((row["block"], row["em"], p, words[w].tobytes(), squeeze(np.concatenate([c[w] for c in cw])), thin(keys[k], PAIR_BYTES), squeeze(np.concatenate([c[k] for c in cp]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 4])], ["block", "em", "part", "w", "wc", "k", "kc"])

    def answer(t: pa.Table) -> pa.Table:
        n = t.num_rows
        out = {"block": pa.array([*t["block"].to_pylist(), None], pa.int64()), "em": pa.array([*t["em"].to_pylist(), None], pa.bool_()), "part": pa.array([t["part"][0].as_py()] * (n + 1), pa.int32())}
        totals = [0, 0, 0]
        for col, cnt, read in (("w", "wc", lambda b: np.frombuffer(b, "<u8")), ("k", "kc", lambda b: thick(b, PAIR_BYTES))):
            keys = [read(b.as_py()) for b in t[col]]
            both = [unsqueeze(b.as_py(), "<u4").reshape(2, -1) for b in t[cnt]]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            every = np.concatenate(both, axis=1).astype(np.float64)
            full, em = np.bincount(at, every[0]), np.bincount(at, every[1])
            if col == "w":
                totals = [int((full > 0).sum()), int(full.sum()), int(em.sum())]
            borders = np.cumsum([len(k) for k in keys])[:-1]
            out[col] = pa.array([squeeze(np.stack([full[x], em[x]]).astype("<u8")) for x in np.split(at, borders)] + [b""], pa.binary())
        return pa.table(out | {c: pa.array([0] * n + [v], pa.int64()) for c, v in zip(("known", "tokens", "em_tokens"), totals)})

    asked = blocks.select("block", "em", "folds", "lens", "ids", "words").mapInArrow(ask, "block long, em boolean, part int, w binary, wc binary, k binary, kc binary")
    return asked.groupBy("part").applyInArrow(answer, "block long, em boolean, part int, w binary, k binary, known long, tokens long, em_tokens long")


def _answered(block: dict, replies: pa.Table, parts: int):
    """The corpus counts (full and held out) of a block's words and pairs, in the block's own order."""
    words, ids, before, keys, at, (wo, wb), (po, pb) = _keys(block, parts)
    out = []
    for col, order, borders in (("w", wo, wb), ("k", po, pb)):
        got = np.zeros((2, len(order)), np.int64)
        for p, b in zip(replies["part"].to_pylist(), replies[col]):
            if borders[p] < borders[p + 1]:
                got[:, borders[p] : borders[p + 1]] = unsqueeze(b.as_py(), "<u8").reshape(2, -1)
        back = np.empty_like(got)
        back[:, order] = got
        out.append(back)
    return ids, before, at, out[0], out[1]


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.where(c > 0, np.frexp(c.astype(np.float64))[1], 0)


def learn_weights(grid: pd.DataFrame, floor: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (pair, word, uniform) for each of 64 buckets from rows (bucket, q2, q1, n).

    q2 and q1 are minus STEPS times the log2 of the estimates; q2 is -1 for a pair not seen.
    A bucket without held-out counts takes the weights of the nearest lower one
    with some, else of the nearest higher; without any, even weights.
    """
    out = np.full((64, 3), 1 / 3)
    g = {k: grid[k].to_numpy() for k in ("bucket", "q2", "q1", "n")}
    p = np.stack([np.where(g[q] < 0, 0.0, 2.0 ** (-g[q] / STEPS)) for q in ("q2", "q1")] + [np.full(len(grid), floor)], axis=1)
    seen = sorted(set(g["bucket"].tolist()))
    for b in seen:
        rows = g["bucket"] == b
        x, n, w = p[rows], g["n"][rows].astype(float), np.full(3, 1 / 3)
        for _ in range(rounds):
            share = x * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
        out[b] = w
    for b in range(64):
        if seen and b not in seen:
            out[b] = out[max((s for s in seen if s < b), default=min(seen))]
    return np.maximum(out, 1e-9) / np.maximum(out, 1e-9).sum(axis=1, keepdims=True)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    A null or empty text is its end token alone.  A null doc_id is scored but
    neither learnt from nor held out.  Repeated rows count and are scored each.
    Texts of any length are scored whole; extra columns are ignored; an empty
    table gives no rows.  score is the log10 probability under the mixture.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a task answers several parts, one after the other
    buckets = buckets_of(parts // 4)
    blocks = bucketed(token_blocks(docs, buckets), "lm-blocks", "block", buckets)
    replies = materialise(count_service(blocks, parts), "lm-replies")
    known, tokens, em_tokens = (int(x or 0) for x in replies.where("block is null").agg(F.sum("known"), F.sum("tokens"), F.sum("em_tokens")).first())
    answers = replies.where("block is not null").select("block", "em", "part", "w", "k")
    floor = 1.0 / (known + 1)

    def smooth(counts: np.ndarray, total: int) -> np.ndarray:
        return (counts + ALPHA) / (total + ALPHA * (known + 1))

    def held_out_grid(b: pa.Table, r: pa.Table) -> pa.Table:
        cells = {}
        for row in b.to_pylist():
            ids, before, at, w, k = _answered(row, r, parts)
            w, k = w[0] - w[1], k[0] - k[1]
            context = w[before]
            with np.errstate(divide="ignore", invalid="ignore"):
                q2 = np.where(k[at] > 0, np.round(-STEPS * np.log2(k[at] / context)), -1)
            q1 = np.round(-STEPS * np.log2(smooth(w, tokens - em_tokens)))[ids]
            found, n = np.unique(np.stack([bucket(context), q2.astype(np.int64), q1.astype(np.int64)]), axis=1, return_counts=True)
            for key, x in zip(zip(*found.tolist()), n.tolist()):
                cells[key] = cells.get(key, 0) + x
        cols = list(zip(*[(*key, n) for key, n in cells.items()])) or [[]] * 4
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("bucket", "q2", "q1", "n"), cols)})

    grid = (
        blocks.where("em").select("block", "ids", "words").groupBy("block").cogroup(answers.where("em").drop("em").groupBy("block"))
        .applyInArrow(held_out_grid, "bucket long, q2 long, q1 long, n long")
        .groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas()  # cells of a grid of fixed size, not of the corpus
    )
    weights = learn_weights(grid, floor)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def score(b: pa.Table, r: pa.Table) -> pa.Table:
        out = []
        for row in b.to_pylist():
            ids, before, at, w, k = _answered(row, r, parts)
            w, k = w[0], k[0]
            word = smooth(w, tokens)
            context = w[before]
            lam = weights[bucket(context)]
            p = lam[:, 0] * (k[at] / np.maximum(context, 1)) + lam[:, 1] * word[ids] + lam[:, 2] * floor
            lens = unsqueeze(row["lens"], np.int64)
            starts = np.cumsum(lens) - lens
            out.append(pa.table({
                "doc_id": rows_of(row["rest"])["doc_id"], "held_out": unsqueeze(row["folds"], np.int8) == TEST_FOLD, "n_tokens": lens,
                "n_known": np.add.reduceat((w > 0)[ids].astype(np.int64), starts), "train_tokens": np.full(len(lens), tokens, np.int64),
                "base_score": np.add.reduceat(np.log10(word)[ids], starts), "score": np.add.reduceat(np.log10(p), starts),
            }))
        return pa.concat_tables(out)

    whole = blocks.where("not em").select("block", "rest", "folds", "lens", "ids", "words").groupBy("block")
    return whole.cogroup(answers.where("not em").drop("em").groupBy("block")).applyInArrow(score, schema)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
