"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, packing. Counted as part of demandlens.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame. All but the last return the
columns of documents, with their types and values. Every stage keeps rows with null ids, repeated rows and columns of any names as its
operator says, and gives no rows for an empty table. run() writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandlens.llm import decontam, langid, packing, pii, simhash
from demandlens.llm.common import written

#: SQL has no string kernels, XXH64 or tokenizers; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language, null, empty and letterless ones; a null language gets the predicted one."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, one with the least id; rows with one id and different texts are different documents."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark window; rows with one id are judged each by its own text."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets and counts n_chars anew; every row stays, also null and empty texts."""
    return pii.mask(docs, "text", "n_chars" if "n_chars" in docs.columns else None)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents; one row per piece, with its ids. Null and empty texts have the end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
