"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte trigrams over its lower-cased words,
normalised to length one.  Each language has several centroids (spherical
k-means over a bounded sample of labelled texts); a text gets the language of
the centroid with the highest cosine, and is rejected where that centroid is
much further away than the labelled texts around it that have about as many trigrams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .blocks import squeeze, unsqueeze
from .common import bounded_batches, table

DIMS, N = 4096, 3
SAMPLE = 300  # labelled texts for each language to fit centroids on, at most: the distinct texts of the smallest hashes
VECTORS = 60_000  # sampled texts of all languages, about: with over VECTORS / SAMPLE languages each gets fewer
CENTROIDS, ROUNDS, SHARE = 4, 20, 0.02
SLACK = 0.25  # a text is rejected below this share of the median cosine of labelled texts of its length around its centroid
CLASSES, MEMBERS, BINS = 13, 20, 64  # classes of length (powers of two of distinct trigrams, up to DIMS), labelled texts a class needs, steps of a cosine
FOLDS, TEST_FOLD = 3, 1
UNKNOWN = "und"
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def term_counts(text: str) -> np.ndarray:
    """How often each hashed trigram occurs; what is no letter is a space, and runs of spaces give none."""
    a = _LETTERS[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))].astype(np.uint32)
    if len(a) < N:
        return np.zeros(DIMS, np.int64)
    v = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return np.bincount((v * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    """By distinct trigrams: a word said a thousand times shows no more of its language than the word."""
    return np.ceil(np.log2(np.maximum(np.count_nonzero(counts, axis=-1), 1))).astype(int)


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length one; starts from texts far apart.  One that holds under SHARE of the texts is an odd text's and goes."""
    chosen, best = [int(np.argmax(x @ x.mean(axis=0)))], None
    while len(chosen) < min(k, len(x)):
        near = x @ x[chosen[-1]]
        best = near if best is None else np.maximum(best, near)
        chosen.append(int(np.argmin(best)))
    c = x[chosen]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    n = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    return c[(n >= SHARE * len(x)) | (n == n.max())]


def typical(hist: np.ndarray) -> np.ndarray:
    """The median cosine of each length class, from the counts (centroids of one language, CLASSES, BINS).

    A class of fewer than MEMBERS texts takes the language's; one that the
    language lacks as well takes the next shorter class's, and where there is
    none, the next longer one's less by the root of the length, as cosines of
    short texts go.
    """

    def median(h):
        return (int(np.searchsorted(np.cumsum(h), h.sum() / 2)) + 0.5) / BINS

    whole = hist.sum(axis=0)
    n = whole.sum(axis=1)
    full = np.flatnonzero(n >= min(MEMBERS, n.max()))
    out = np.zeros(hist.shape[:2], np.float32)
    for k in range(CLASSES):
        at = full[max(0, np.searchsorted(full, k, "right") - 1)]
        out[:, k] = median(whole[at]) * 2.0 ** (min(0, k - at) / 2)
        for j in np.flatnonzero(hist[:, k].sum(axis=1) >= MEMBERS):
            out[j, k] = median(hist[j, k])
    return out


def typical_cosines(usable: DataFrame, model: dict) -> np.ndarray:
    """The median cosine of all labelled texts (text, lang) around each centroid of their own language, by length class."""
    langs, centroids, idf = np.array(model["langs"]), model["centroids"], model["idf"]

    def around(batches):
        hist = {}
        for b in batches:
            texts, labels = b.column("text"), np.array(b.column("lang").to_pylist(), object)
            for at in range(0, len(texts), 256):
                counts = np.stack([term_counts(t.as_py()) for t in texts[at : at + 256]])
                cos = np.where(labels[at : at + 256, None] == langs[None], weigh(counts, idf) @ centroids.T, -1)
                best = cos.argmax(axis=1)
                top = cos[np.arange(len(cos)), best]
                use = (top >= 0) & (counts.sum(axis=1) > 0)
                for key in zip(best[use].tolist(), length_class(counts)[use].tolist(), np.minimum(top[use] * BINS, BINS - 1).astype(int).tolist()):
                    hist[key] = hist.get(key, 0) + 1
        cols = list(zip(*[(*k, n) for k, n in hist.items()])) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["j", "k", "bin", "n"])

    hist = np.zeros((len(langs), CLASSES, BINS), np.int64)
    for r in usable.select("text", "lang").mapInArrow(around, "j long, k long, bin long, n long").groupBy("j", "k", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r["j"], r["k"], r["bin"]] = r["n"]
    out = np.zeros((len(langs), CLASSES), np.float32)
    for lang in set(model["langs"]):
        out[langs == lang] = typical(hist[langs == lang])
    return out


def fit(docs: DataFrame) -> dict:
    """idf and typical cosines over all labelled texts of docs (doc_id, text, lang), and centroids from the bounded sample.

    Rows without text or lang teach nothing; a null or repeated doc_id is a row
    like any other, and each text of a language is drawn once.  Texts of any
    length count whole; extra columns are ignored; an empty table gives a model
    that rejects everything.  The model holds up to CENTROIDS vectors of DIMS
    for each language and the driver about VECTORS sampled texts: both are
    bounded by the number of languages, not of rows.
    """
    usable = bounded_batches(docs).where("text is not null and lang is not null")

    def document_frequencies(batches):
        df = np.zeros(DIMS, np.int64)
        n = 0
        for b in batches:
            for x in b.column("text"):
                df += term_counts(x.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate(([n], df)))], ["dim", "n"])

    counts = {r["dim"]: r["n"] for r in usable.select("text").mapInArrow(document_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(-1) or 0
    idf = np.log((1 + total) / (1 + np.array([counts.get(d, 0) or 0 for d in range(DIMS)]))).astype(np.float32) + 1

    # The smallest hashes of each language's texts, each text once: null or repeated doc_ids and copies of a text
    # neither use up the sample nor enlarge it.  All but about 20 * SAMPLE texts of a language are left out before
    # they are ranked, so no task ranks a large language whole.
    keyed = usable.select("lang", "text", F.xxhash64("text").alias("t"))
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("t").alias("count")).collect()  # a row for each language
    if not sizes:
        return {"idf": idf, "langs": [], "centroids": np.zeros((0, DIMS), np.float32), "typical": np.zeros((0, CLASSES), np.float32)}
    spark, sample = docs.sparkSession, max(1, min(SAMPLE, VECTORS // len(sizes)))
    # both tables that rows meet have at most VECTORS rows, unless there are more languages than that
    sent = F.broadcast if len(sizes) <= VECTORS else (lambda df: df)
    below = spark.createDataFrame([(r["lang"], min(1 << 40, 20 * SAMPLE * (1 << 40) // r["count"])) for r in sizes], "lang string, below long")
    few = keyed.select("lang", "t", F.pmod("t", F.lit(1 << 40)).alias("h")).join(sent(below), "lang").where("h < below").select("lang", "h", "t").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    chosen = [(r["lang"], r["t"]) for r in few.withColumn("r", rank).where(F.col("r") <= sample).collect()]

    def sampled(batches):
        seen = set()
        for b in batches:
            new = []
            for lang, t, x in zip(b.column("lang").to_pylist(), b.column("t").to_pylist(), b.column("text")):
                if (lang, t) not in seen:
                    seen.add((lang, t))
                    new.append((lang, t, squeeze(term_counts(x.as_py()).astype("<i4"))))
            cols = list(zip(*new)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary()))], ["lang", "t", "terms"])

    # a task gives each text once
    found = keyed.join(sent(spark.createDataFrame(chosen, "lang string, t long")), ["lang", "t"], "left_semi").select("lang", "t", "text").mapInArrow(sampled, "lang string, t long, terms binary")
    rows: dict[str, list] = {}
    for r in found.groupBy("lang", "t").agg(F.max("terms").alias("terms")).collect():
        rows.setdefault(r["lang"], []).append(bytes(r["terms"]))
    langs, cents = [], []
    for lang in sorted(rows):
        x = np.array(sorted(unsqueeze(t, "<i4").tolist() for t in rows[lang]))
        x = weigh(x[x.sum(axis=1) > 0], idf)
        if len(x):
            c = cluster(x)
            langs += [lang] * len(c)
            cents.append(c)
    model = {"idf": idf, "langs": langs, "centroids": np.concatenate(cents) if cents else np.zeros((0, DIMS), np.float32)}
    return model | {"typical": typical_cosines(usable, model) if langs else np.zeros((0, CLASSES), np.float32)}


def predict_texts(texts: list[str | None], model: dict) -> list[tuple[str, float, bool]]:
    """(language, cosine, rejected) of each text."""
    out = []
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        if not model["langs"]:
            out += [(UNKNOWN, 0.0, True)] * len(part)
            continue
        counts = np.stack([term_counts(t or "") for t in part])
        cos = weigh(counts, model["idf"]) @ model["centroids"].T
        best = cos.argmax(axis=1)
        low = SLACK * model["typical"][best, length_class(counts)]
        for t, j, c, least in zip(part, best.tolist(), cos[np.arange(len(part)), best].tolist(), low.tolist()):
            out.append((model["langs"][j], min(1.0, max(0.0, c)), c < least) if has_letter(t) else (UNKNOWN, 0.0, True))
    return out


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected for every row of docs (doc_id, text).

    A null text or one without a letter is ``und``, score 0, rejected; so is
    every text if nothing could be learned.  Ties go to the first language in
    alphabetical order.  Whole texts of any length are used; repeated rows
    repeat; extra columns are ignored; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = predict_texts(b.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs whose text is not rejected, with all their columns, in one pass over docs.

    A null or empty text, or one without a letter, is rejected; a null doc_id is
    a row like any other; repeated rows stay or go together; texts count whole;
    an empty table gives none.
    """

    def run(batches):
        for b in batches:
            keep = [not r for _, _, r in predict_texts(b.column("text").to_pylist(), model)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold() == TEST_FOLD, F.lit(False))  # without a doc_id a row is not held out, so it teaches
    model = fit(docs.where(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
