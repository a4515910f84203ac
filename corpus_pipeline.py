"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes to the
shared folder and reads again as the next stage's docs.  All stages but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import OPEN, Saved, shared_dir, table
from tidelog.llm.op2_packing import pack_sequences
from tidelog.llm.op3_language import identify, train
from tidelog.llm.op5_suffix_dedup import remove_repeats
from tidelog.llm.op6_jaccard_join import keep_one
from tidelog.llm.op7_decontamination import contamination

#: Least fit of a kept document: the log-likelihood of an n-gram in the mixture of languages, on
#: average, over that of n-grams drawn evenly.
LEAST_FIT = 0.0

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stage before has kept aside.
_aside: list[Saved] = []


def stage(f: Stage) -> Stage:
    """A stage that first drops what the one before has kept aside: its rows have been written, as `docs`."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _aside:
            if (left := _aside.pop()).spark.sparkContext is spark.sparkContext:
                left.drop()
        before = list(OPEN)
        out = f(spark, docs, sf_dir)
        _aside.extend(x for x in OPEN if x not in before)
        return out

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: those without a letter, and those whose n-grams the
    mixture of languages explains worse than chance (lang_fit below LEAST_FIT), such as
    texts in unknown scripts.

    The model learns from the documents that carry a label; without any, all documents that
    have a letter stay."""
    return identify(docs, train(docs), fit=True).where(F.col("lang_fit") >= LEAST_FIT).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies: Jaccard
    similarity of five-word shingles of 0.8 or more, and what such links join."""
    return keep_one(docs, percent=80, shingle=5)


@stage
def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes what repeats 50 bytes or more of a document of smaller id; a document of
    which nothing but white space is left goes.  n_chars follows the text."""
    got = remove_repeats(docs)
    left = got.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns(new).select(*docs.columns)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.  Documents with a null text hold none;
    rows that are repeated go or stay together."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*docs.columns)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens.  Workers keep fewer pieces' ids than
    elsewhere, as executors have come through four stages by then."""
    return pack_sequences(docs, capacity=1024, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=0, cached=300_000)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_text", repeated_text), ("benchmark_leaks", benchmark_leaks), ("sequences", sequences)]

#: SQL can't express mixture inference or byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
