"""Corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  Every stage
works on all that its predecessor kept.  All stages but the last return the
columns of ``documents`` for the documents they keep; the last returns the
packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shoplens.llm import near_dup, packing, quality, toxicity
from shoplens.llm.common import read_table, stored
from shoplens.llm.queries import fold


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or consist of lines that recur across their host go."""
    return quality.good_documents(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches 0.5 go; learned on the labels whose fold of 5 is not 0."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels").filter(fold(5) != 0))
    return toxicity.clean_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return near_dup.one_of_each(docs, percent=85)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_documents), ("near duplicates", near_duplicates),
          ("packing", pack)]

ORACLE_SQL = None  # token ids, learned scores and components are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is a stored table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
