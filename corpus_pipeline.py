"""The corpus pipeline: quality rules, line dedup, one of each near-duplicate group, mixing, tokens.

Each stage works on all that its predecessor kept and returns the columns of ``documents``; the last returns token
counts and digests. Repeated documents of the mix stay repeated rows. Belongs to the subpackage ``trialgrid.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm import op2_bpe, op3_ngram_join, op7_mixing, op8_line_dedup, op9_quality_rules
from trialgrid.llm.shared import arrow_rows, stored

#: Rows of a batch of whole texts for the tokenizer's workers: four of an executor's hold some at the same time.
TOKEN_ROWS = 500


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return op9_quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows."""
    out = op8_line_dedup.drop_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return op3_ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions; a document taken more than once is that many rows."""
    return op7_mixing.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document; written here, so that the batches' size holds for this stage only."""
    coded = op2_bpe.encode_and_decode(docs, ["doc_id", "source", "lang"])
    with arrow_rows(spark, TOKEN_ROWS):
        return stored(coded.select("doc_id", "source", "lang", *op2_bpe.digests(coded)))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("tokens", tokens)]

#: SQL can express neither the near-duplicate classes nor the merges; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
