"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.jaccard import keep_one
from harborline.llm.line_dedup import dedup_lines
from harborline.llm.packing import pack_documents
from harborline.llm.quality import THRESHOLD, fit_quality, score_quality
from harborline.llm.secret_scan import redact, scan_secrets
from harborline.plans.registry import table
from harborline.session import materialize, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# SQL can't express the classifier.
ORACLE_SQL = None
# Bytes of whole texts that Spark hands to a Python worker at once. With its default of 64 MB (10 000 rows) the executor
# and the worker each hold a batch and its result for every task, and neither gives all of it back.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def _ready(spark: SparkSession) -> None:
    """Before a stage with Python workers: the package shipped to them, batches of bounded bytes."""
    ship_package(spark)
    spark.conf.set(*BATCH)


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, the length brought up to date."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    _ready(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, out="_score").filter(F.col("_score") >= THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first only."""
    return _documents(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8)."""
    _ready(spark)
    return keep_one(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked."""
    return _documents(redact(scan_secrets(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with the sequence and offset they go to."""
    _ready(spark)
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again for the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
