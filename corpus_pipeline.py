"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import ngram_join, packing, quality, secrets, suffix_dedup
from kgspark.llm.common import Scratch, packed, read_table, unpacked


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(spark, docs, sf_dir)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest doc_id. Of rows that share that doc_id the
    smallest by text stays; rows without doc_id, which belong to no group, all stay."""
    found = ngram_join.jaccard_components(spark, docs).select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_component"))
    firsts = found.where(F.col("_id") == F.col("_component")).select(F.col("_id").alias("doc_id")).distinct()
    rows = packed(docs, "doc_id", "text")
    kept = rows.join(firsts, "doc_id", "left_semi")
    several = kept.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    one = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("_row", F.struct(F.coalesce("text", F.lit("")), F.to_json("_row"))).alias("_row"))
    whole = kept.join(several, "doc_id", "left_anti").select("_row").union(one.select("_row")).union(rows.where("doc_id is null").select("_row"))
    return unpacked(whole, docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document of smaller doc_id holds are cut out of the text."""
    return suffix_dedup.dedup_text(spark, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return secrets.redact(docs, secrets.train(docs.select("doc_id", "text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized and packed to sequences."""
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: No SQL can express the classifier or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs, f"stage{i}")
    return docs
