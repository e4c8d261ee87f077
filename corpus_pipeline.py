"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.llm.lines import dedup_lines
from draftlake.llm.neighbours import keep_one
from draftlake.llm.packing import pack_documents
from draftlake.llm.secrets import redact
from draftlake.llm.toxicity import drop_toxic
from draftlake.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the model learns from the documents and labels of ``sf_dir``."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; documents of which nothing is left go with them."""
    kept = dedup_lines(docs)
    empty = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return _counted(kept.where(~F.coalesce(empty, F.lit(False))))


def neighbours(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return keep_one(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all documents stay."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("n-gram join", neighbours), ("secrets", secrets), ("packing", packing)]

#: Toxicity scores and best-fit packing have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each is written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
    return docs
