"""Corpus pipeline: language, near duplicates, repeated passages, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import language, mixing, near_duplicates, packing, substrings
from lodestrata.llm.common import cut, fresh, scratch

#: Model decisions, rounding and packing have no SQL form; see tests/llm.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those where no language is likelier than not; without labelled rows, none."""
    return language.kept(docs, language.fit(docs))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the least doc_id. Null doc_ids and rows that share one stay unless linked."""
    return near_duplicates.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller doc_id has; documents left without a word go.
    Null sorts before all doc_ids; rows that share a doc_id take nothing from each other and all stay."""
    found = substrings.remove_repeats(docs, keep_text=True).where("n_words > n_removed")
    # What stays of a text hangs on it and the doc_id alone, so rows equal in both have the same.
    key, of, text, mark = fresh(docs.columns, "_id", "_of", "_text", "_mark")
    found = found.select(F.col("doc_id").alias(key), F.col("mark").alias(of), F.col("text").alias(text)).dropDuplicates([key, of])
    rest = docs.withColumn(mark, F.xxhash64("text")).drop("text", "n_chars")
    joined = rest.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(of)))
    return joined.withColumn("text", F.col(text)).withColumn("n_chars", F.length(text).cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicate_join", near_duplicate_join),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again, and
    then the tables go that the stage wrote on its way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = cut(stage(spark, docs, sf_dir), name)
            made.remove(docs.cut_at)
    return docs
