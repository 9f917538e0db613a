"""Corpus preparation from raw documents to packed sequences.

Every stage takes the rows its predecessor kept, and all but the last return the columns of
``documents``. A stage drops or changes only what its operator rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieweave.llm import decontamination, fuzzy_lines, ngram_join, packing, toxicity
from tieweave.llm.registered import tokenizer_path

#: Near copies: words of an n-gram and least share in per cent.
COPY_WORDS, COPY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled ones, does not call toxic."""
    return toxicity.not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each group of like lines kept once; ``n_chars`` follows the text."""
    rid = fuzzy_lines.without_fuzzy_lines(docs)
    return rid.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return ngram_join.one_of_each(docs, COPY_WORDS, COPY_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 2,048 tokens."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained weights and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
