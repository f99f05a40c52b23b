"""Cleaning and packing of ``documents`` in five stages, each a training-data operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``, whatever their names.

Null and empty texts pass the toxicity stage (unless most labelled rows are toxic) and go in the language stage, as do texts
without a letter. Of rows that are repeated whole, all stay or go together until the substrings stage, which treats them as one
document; rows that share a doc_id with different texts share its fate in the near-duplicates stage. A null doc_id is never a
duplicate of another; in the substrings stage it comes first. Very long texts are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import language, near_dup, packing, substring, toxicity
from loomgraph.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text, without letters, or with few n-grams of the language found go."""
    return language.identified(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least doc_id."""
    return near_dup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier go; n_chars follows the text."""
    cut = substring.cut(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_passages),
    ("packing", pack),
]

ORACLE_SQL = None  # the stages learn, hash and tokenize, which SQL does not express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
