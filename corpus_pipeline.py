"""From documents to packed training sequences, in stages that each keep, drop or place documents.

Every stage reads all that the one before kept and returns the columns of ``documents``; the
last returns the packing. ``run`` writes what a stage returns to the shared folder and reads it again, so a
lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import ecoc, grouping_pack, ordinal, simhash
from stratalens.llm.common import stored, table
from stratalens.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor and toxic documents go: an ordinal model learns from the labelled rows that are here.

    Null and empty texts are graded like any text without features; rows of one id each by their own text.
    """
    model = ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels")), grades=3)
    return ordinal.select_documents(docs, model, least_grade=2)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or whose language is not clear go, null and empty texts among them."""
    return ecoc.select_documents(docs, ecoc.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Linked are fingerprints two bits or fewer apart (three-word shingles), and texts that share 0.8 of their five-word shingles.

    Null and blank texts are one group. Rows of one id are one document: of these the first in the order of all their
    columns stays. Rows without an id cannot be told apart and all stay.
    An empty table gives no rows.
    """
    found = simhash.near_copies(docs)
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.join(kept, F.col("row.doc_id") == F.col("doc_id"))
    # Copies of one id are merged before the shuffle, so that many of them never meet in one task.
    first = rows.where("n > 1").groupBy("doc_id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    unnamed = whole.where("row.doc_id is null")
    return rows.where("n = 1").select("row").unionByName(first.select("row")).unionByName(unnamed).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents goes; a null or empty text is one piece of one token."""
    return grouping_pack.packed(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Trained models and the packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
