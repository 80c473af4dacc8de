"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, html_extract, jaccard, packing, quality, secrets, sharding, warc
from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.read_back(chat.format_turns(turns.unionByName(chat.probe(spark)))))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sharding.shard(table(spark, sf_dir, "documents"))
    text = F.col("text")
    return kept.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), "lang", "source", "n_chars")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_quality": op2_quality, "op3_chat_format": op3_chat_format, "op4_warc": op4_warc, "op5_jaccard": op5_jaccard, "op6_packing": op6_packing, "op7_sharding": op7_sharding, "op8_secrets": op8_secrets, "op9_html": op9_html, "op10_ann": op10_ann}
SQL: dict[str, str] = {"op2_quality": quality.ORACLE, "op3_chat_format": chat.ORACLE, "op4_warc": warc.ORACLE, "op7_sharding": sharding.ORACLE, "op8_secrets": secrets.oracle()}
