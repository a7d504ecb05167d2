"""Toxicity, line dedup, near-dedup, decontamination and token ids of the documents, one stage after the other.

Each stage gets what the one before kept, as it was written; all but the last return the columns of documents. Rows are
kept as they are but for the text (and, where there is such a column, its length in ``n_chars``) after line dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe, decontaminate, lines, neardup, toxicity
from tidegate.llm.common import ship, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score the threshold or more; learnt from labels outside the held-out third."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn_from=~toxicity.held_out())
    return toxicity.scored(docs, model, below=toxicity.THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = lines.dedup_lines(docs, counts_to=None)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the least id stays; texts that are copies of nothing stay, whatever their ids."""
    ship(spark)
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digests(docs)


STAGES = [("toxicity", toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("token_ids", token_ids)]
#: A trained classifier and minima of hashes are not for SQL to express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
