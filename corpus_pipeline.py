"""A corpus pipeline over documents: quality rules, near-duplicates, benchmark leaks, personal data, mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and the
last returns them with size, source_size, target and taken. Rows are told apart by doc_id and the text's hash, joined so
that nulls meet: repeated ids with other texts are judged apart, and rows with null ids like any others.

All stages: empty tables give empty results; null texts are empty texts; very long texts are read whole; other columns stay
as they are, and names that a stage needs for itself give way to theirs. Equal rows are kept or dropped together, but for
near-duplicates, which keep one row of each group: the least doc_id, null last, then the least hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.benchmark_windows import leaks
from tidemark.llm.common import free_name, saved, sized_broadcast, table
from tidemark.llm.near_copies import near_copies
from tidemark.llm.pii_votes import redact
from tidemark.llm.quality_llr import quality
from tidemark.llm.source_mix import mix

#: Sets of rows up to so many are broadcast (two longs each); larger ones are joined by shuffle.
BROADCAST_IDS = 200_000


def _rows(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The rows of docs that are in found (doc_id, th), or are not."""
    d, t, th = (free_name(docs, x) for x in ("_d", "_t", "_th"))
    found = saved(found.select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct(), "rows-of-a-stage")
    marked = docs.withColumn(th, F.xxhash64("text"))
    return marked.join(sized_broadcast(found, BROADCAST_IDS), (F.col(th) == F.col(t)) & F.col("doc_id").eqNullSafe(F.col(d)), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    judged = quality(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), table(spark, sf_dir, "labels"), keep=("doc_id", "th"))
    return _rows(docs, judged.where("not kept"), "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, once."""
    one = _rows(docs, near_copies(docs).where("th = first_th and doc_id <=> first_id"), "left_semi")
    return one.dropDuplicates(["doc_id", one.columns[-1]]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return _rows(docs, leaks(docs, table(spark, sf_dir, "benchmark"), by_text=True), "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, and what the mix takes of each."""
    return mix(docs, keep=True)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("benchmark", decontaminate), ("personal data", personal_data), ("mix", mix_sources)]
#: SQL expresses neither the hashed models nor the fingerprints; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "-"))
    return docs
