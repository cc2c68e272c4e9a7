"""Corpus clean-up over ``documents``: five stages, each written as Parquet and read again by the next.

toxicity: documents scored 0.5 or more go.  exact_dedup: of equal texts the
longest, then the smallest id stays.  ngram_join: of each component of documents
whose sets of five-word shingles have a Jaccard similarity of 0.8 or more the
smallest id stays.  decontaminate: documents that hold a benchmark
window go.  bpe: encodes what is left and decodes it again.  All stages but the
last return the columns of ``documents``; a text without content has nothing to
be dropped for, but equals other such texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitsift.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from bitsift.llm.common import materialise
from bitsift.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: ~toxicity.held_out(i))
    return toxicity.reject(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.reject(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: SQL can't express scores, components or merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
