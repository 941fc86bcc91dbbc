"""The operators' queries over the test tables: each applies its operator with
production parameters to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, oracles, quality
from .common import table
from .embeddings import near_vectors
from .licenses import scan
from .line_dedup import dedup_lines
from .mixing import mix
from .ngram_join import near_duplicates
from .packing import pack
from .sharding import shard
from .suffix_dedup import dedup_substrings

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.col("text").cast("binary")
    return shard(docs, 8).select(
        "doc_id",
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("").cast("binary"))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = language.learn(docs.where(~language.held_out("doc_id")))
    out = language.predict(docs.select("doc_id", "text"), known)
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, n=5, threshold=0.8).drop("text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crf = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, crf).drop("text")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_embeddings": op7_embeddings,
    "op9_licenses": op9_licenses,
    "op8_ngram_join": op8_ngram_join,
    "op10_quality": op10_quality,
}

ORACLES = {"op1_mixing": oracles.OP1, "op3_line_dedup": oracles.OP3, "op4_suffix_dedup": oracles.OP4, "op9_licenses": oracles.OP9, "op7_embeddings": oracles.OP7, "op8_ngram_join": oracles.OP8}
