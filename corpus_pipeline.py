"""A training-data pipeline of five stages, each one of the operators of bagdiv.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, whatever their names. Between stages the rows are written as Parquet and read again.

Every stage takes empty tables, null and empty texts, texts of any length and repeated rows; a doc_id may be null.
Rows of one doc_id are told apart by their texts where a stage judges texts, and are parts of one document where it
compares documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; equal texts go or stay together. No rows give none."""
    from bagdiv.llm import common, quality_rules

    return quality_rules.filtered(docs, common.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller doc_id holds go from the texts; n_chars follows the text.

    Null texts stay null. Rows of one doc_id keep the lines that they share, and rows without one all theirs.
    """
    from bagdiv.llm import line_dedup

    out = line_dedup.without_repeated_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (runs of five words, similarity 0.8) the smallest doc_id stays, with all its rows.

    Texts without words and rows without a doc_id link with nothing and stay.
    """
    from bagdiv.llm import ngram_jaccard

    return ngram_jaccard.without_near_copies(docs, percent=80, k=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words never. A null source is one of the sources; rows that
    are alike share evenly what is taken of them."""
    from bagdiv.llm import mixing

    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each copy in the mix; a null text counts as empty."""
    from bagdiv.llm import bpe, queries

    return bpe.encode(docs, queries.tokenizer_path(queries.WORD_BPE), keep=False)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_copies), ("mixing", mixture), ("bpe", encoding)]

#: The stages learn rules and use a tokenizer file, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, in a table that stays. What a stage and its operator wrote goes when the next one is written."""
    from bagdiv.llm import common
    from bagdiv.tables import deleted, scratch

    docs = common.table(spark, sf_dir, "documents")
    folder, before = f"{common.checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", []
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        deleted(spark, *before)
        before = [f"{folder}/{name}"]
    return docs
