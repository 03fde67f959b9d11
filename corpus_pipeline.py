"""A training corpus from raw documents: five stages, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as
Parquet and reread as the next one's docs.  Columns that documents have beside
their own pass through; repeated rows, very long and empty texts and empty tables
are rows and tables like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.common import drop_scratch, made_so_far, scratch, table
from marlstone.llm.exact_dedup import keep_first_seen, new_index
from marlstone.llm.lang_id import fit, keep_identified
from marlstone.llm.packing import pack
from marlstone.llm.simhash import keep_representatives
from marlstone.llm.suffix_dedup import without_repeats


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that identification rejects go, null and letterless texts among them."""
    return keep_identified(docs, fit(docs.select("doc_id", "text", "lang")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id; null texts count as empty, and of texts without any doc_id one row stays."""
    return keep_first_seen(docs, new_index(spark, id_type=docs.schema["doc_id"].dataType.simpleString()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest doc_id; rows without a doc_id stay."""
    return keep_representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that start elsewhere too; n_chars follows the text, and a null text stays null."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(cut.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; null texts are their end id alone."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Language models, fingerprints over words, suffix sorting and BPE are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has left behind goes once its rows are written."""
    docs, mark = table(spark, sf_dir, "documents"), made_so_far()
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        drop_scratch(spark, mark, keep=(path,))
    return STAGES[-1][1](spark, docs, sf_dir)
