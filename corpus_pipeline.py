"""The corpus pipeline: quality classifier, line dedup, near-duplicates, substring dedup, packing.

``run`` applies the stages to the documents table; each stage's result is written to
the shared folder and read again as the next one's input.

In every stage rows are told apart by doc_id and a digest of the text, so rows of one doc_id
with other texts are documents of their own. Rows without doc_id are never judged: every
stage keeps them, and they are packed. Null and empty texts have no lines, shingles or
passages; those that are drawn pack as the single id 0. Texts are taken whole at any length.
An empty table gives an empty one; other columns, whatever their names, pass through all
stages but the last, save n_chars, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urlgrove.llm import line_runs, near_duplicates, packing, passages, resampling
from urlgrove.llm.queries import vocabulary
from urlgrove.llm.store import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return resampling.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines are deleted; documents of which nothing is left go."""
    return line_runs.delete_runs(docs, Scratch(spark, "lines"), min_lines=1)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_duplicates.drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages are cut out of the texts."""
    return passages.delete_passages(docs, Scratch(spark, "passages"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their places in sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near), ("substring dedup", substrings), ("best-fit packing", pack)]

#: Resampling by hashed models and seeded noise has no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
