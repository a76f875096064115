"""From raw documents to packed training sequences, stage by stage.

A stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return rows of ``docs`` as
they are; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import exact_dedup, lang_id, ngram_join, packing, quality_trees
from tabwright.llm.common import table, written
from tabwright.llm.queries import TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees learned from `labels` predict to be of quality 1. Null and empty texts are judged too."""
    return quality_trees.keep_good(docs, quality_trees.learn_quality(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; one that is null or has no letter goes."""
    return lang_id.keep_known(docs, lang_id.learn_languages(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, similarity 0.8) the row with the smallest doc_id."""
    return ngram_join.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", quality_stage), ("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: learned models and signatures have no SQL; each stage is tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of one scale; each stage's rows are written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
