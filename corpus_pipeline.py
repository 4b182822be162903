"""From raw documents to packed sequences: quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases, for every stage: a null or empty text has no words (quality rules reject it, the others keep it); rows without
doc_id, repeated rows and several texts under one doc_id are rows like others (near-duplicates keeps one of each group, whatever
its doc_id); very long texts are read whole; further columns, whatever their names, go through unchanged (packing returns its own
columns); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulefact.llm import mixing, neardup, packing, quality
from rulefact.llm.common import read_table, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger rejects go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets of similarity 0.8 or more stays."""
    return neardup.deduplicated(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document taken k times becomes k rows."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document goes to a training sequence."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Sampling, registers and tokens have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
