"""A corpus pipeline: toxicity, language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. Rows that share a doc_id are documents of
their own. All but the last return the columns of documents as they came, extra ones included; the last returns packed pieces.
Edge cases are those of the operators: null and empty texts are not toxic, have no language (and go), and an empty
table goes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, ngram_join, packing, toxicity
from tidemark.llm.rows import ids_repeat, one_of_each, only
from tidemark.llm.storage import stored

END_ID, SEQUENCE = 2, 1024


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every learned language, go."""
    return language_id.accepted(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the smallest doc_id stays."""
    if ids_repeat(docs):
        linked = lambda rows: ngram_join.jaccard_components(rows, words=5, percent=80).select("doc_id", "component_id")
        return one_of_each(docs, linked, largest=False)
    near = ngram_join.jaccard_components(docs, words=5, percent=80)
    return only(docs, near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack),
]

#: No SQL: the first two stages are trained models and the last calls a tokenizer; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
