"""The corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark passages'
documents go, personal data are redacted, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and
reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import WorkTables, documents_of, small_batches
from gridloom.llm.decontaminate import clean_documents
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import without_personal_data
from gridloom.llm.queries import vocabulary
from gridloom.llm.simhash import one_of_each
from gridloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, documents_of(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return one_of_each(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, documents_of(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs, 2048, vocabulary(), 0)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: Training, similarity links and tokenization are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = WorkTables(spark, "pipeline"), documents_of(spark, sf_dir)
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
