"""A corpus pipeline in stages of mediaframe.llm: quality rules, near duplicates, secrets, packing.

run() applies STAGES to documents; each stage's rows are written as Parquet to the shared folder and read again as
the next one's input, so a lost executor costs a stage's tasks and never the stages before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm import jaccard, packing, quality, secrets
from mediaframe.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go."""
    names = docs.columns
    return quality.judge(docs).where("kept").select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id, and of its repeated rows one.

    Documents without an id or without words are in no class and stay.
    """
    names = docs.columns
    others = jaccard.join(docs).select("doc_id", "component_id").where("doc_id <> component_id").select("doc_id").distinct()
    others, _ = written(others, "near-copies")
    # Ids are 8 bytes each: up to the bound they are broadcast and texts stay where they are, beyond it the join shuffles.
    gone = F.broadcast(others) if others.count() <= jaccard.BROADCAST_IDS else others
    left = docs.join(gone, "doc_id", "left_anti").select(*names)
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    alone = left.where("doc_id IS NULL")
    return left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(alone)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and n_chars counted anew where a text changed."""
    names = docs.columns
    out = secrets.redact(docs.withColumn("__before", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("__before"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Jaccard classes and tokenizers are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None
