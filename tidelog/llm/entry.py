"""The registered queries of the ten operators, and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import shared_dir, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op1_token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op2_packing import pack_sequences

    return pack_sequences(table(spark, sf_dir, "documents"), capacity=1024, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op3_language import held_out, identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang_shares")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op4_licenses import scan_licenses

    got = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.concat_ws(",", "licenses").alias("licenses"), "category", "n_sentences", "n_unknown")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op5_suffix_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op6_jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), percent=85, shingle=4)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op7_decontamination import contamination

    got = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op8_token_files import read_documents, write_token_files

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_documents(spark, path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op9_sharding import byte_shards

    got = byte_shards(table(spark, sf_dir, "documents"), shards=16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.op10_embedding_dedup import near_duplicates

    got = near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return got.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_token_counts, op2_packing, op3_language, op4_licenses, op5_suffix_dedup, op6_jaccard_join, op7_decontamination, op8_token_files, op9_sharding, op10_embedding_dedup, pipeline]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express: not byte-level BPE, mixture inference, or CRC-32."""
    from tidelog.llm.oracles import ORACLES

    return ORACLES
