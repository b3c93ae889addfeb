"""Corpus pipeline: quality, near copies, benchmark passages, personal data, token pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; ``run`` writes each stage's
rows to the shared folder and reads them again as the next one's docs. All stages but the last return the columns of
documents.

Defined results, for every stage: doc_id may be null or repeated; such rows are carried by a number of their own, and
copies of a row are near copies of each other like any others, so one of them stays. A null or empty text is kept by the
quality, decontamination and personal data stages; it has no copies, hits, spans or pieces. Long texts are taken whole.
Of equal copies the smallest doc_id stays, null ids last. An empty table gives an empty table, and columns of any name,
also those that the operators use themselves, pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltra.llm import common, decontaminate, near, pieces, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the smallest doc_id, null ids last, then by a hash of the text and the row's place."""
    keyed, key = common.keyed(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"), F.col(key).alias("row"))
    classes = near.join(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "class_id")
    kept = classes.join(keyed.select(key, order.alias("order")), key).groupBy("class_id").agg(F.min("order").alias("least"))
    return keyed.join(kept.select(F.col("least.row").alias(key)), key, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated with benchmark items; each is judged by its own text, whatever its doc_id."""
    keyed, key = common.keyed(docs)
    hits = decontaminate.report(decontaminate.contamination(keyed.select(F.col(key).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark")))
    return keyed.join(hits.filter("contaminated").select(F.col("doc_id").alias(key)), key, "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces: what they are, and that they decode to the text."""
    return pieces.round_trip(docs)


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("pieces", pieces_stage)]

#: No SQL: stages train models and encode pieces. tests/llm compares run() with brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
