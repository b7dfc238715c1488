"""Corpus pipeline: documents pass through stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All stages but the last return the
columns of documents. ``run`` applies them in order to the documents table.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm import bpe, mixing, quality, simhash, suffixes
from paperlode.llm.common import unused
from paperlode.session import drop_scratch, scratch_made, scratch_path, settle


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs).filter("kept").select(*docs.columns)


def counted(docs: DataFrame) -> DataFrame:
    """The documents with the number of characters that their texts have now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: windows of five words, exact
    similarity 0.8 of pairs that anchors of twelve fingerprints bring together."""
    return simhash.one_of_each(docs, size=5, prints=12, similarity=0.8)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that repeat. A letter that a cut goes through
    goes as a whole; a document that loses everything stays, with an empty text."""
    cleaned, cut = suffixes.remove_repeats(docs), F.size("removed") > 0
    parts = {"text": F.when(~cut, F.col("text")), "kept": F.when(cut, F.col("kept"))}
    # Stored, as two Python steps in one task would be two workers beside each other.
    cleaned = settle(cleaned.withColumns(parts).select(*docs.columns, "kept"), "cleaned")
    text = F.when(F.col("kept").isNotNull(), suffixes.readable(F.col("kept"))).otherwise(F.col("text"))
    return counted(cleaned.withColumn("text", text)).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return counted(mixing.dealt(mixing.mix(docs, keep_text=True))).select(*docs.columns)


#: Pre-tokens of a generation that a worker of the last stage remembers. Workers stay with what they
#: remember beside the JVM while other stages run.
REMEMBERED = 100_000


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, with the ids of its tokens, their number and the digest
    of the bytes that they decode to; ids that do not give the text back are an error."""
    digest = unused(docs, "text_sha256")
    told = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    stored = settle(bpe.encode(told, remembered=REMEMBERED), "encoded")  # encoding and decoding in the same workers
    encoded = stored.withColumn("decoded_sha256", F.sha2(bpe.decode(F.col("ids")), 256))
    differ = F.raise_error(F.lit("decoded bytes are not those of the text")).cast("binary")
    ids = F.when(F.col("decoded_sha256") == F.col(digest), F.col("ids")).otherwise(differ)
    counted_ids = encoded.withColumn("ids", ids).withColumn("n_tokens", F.floor(F.octet_length("ids") / 4))
    return counted_ids.drop(digest)


#: Scratch that the last stage of a thread has left.
_left = threading.local()


def cleared(stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; what the stage before it left in the scratch folder goes first. A stage's result
    is written before the next one starts, and runs at the same time are in threads of their own,
    each with its own scratch."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, getattr(_left, "made", []))
        with scratch_made() as made:
            out = stage(spark, docs, sf_dir)
        _left.made = made
        return out

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", cleared(rule_stage)),
    ("simhash_near_dedup", cleared(near_stage)),
    ("suffix_dedup", cleared(suffix_stage)),
    ("source_mix", cleared(mix_stage)),
    ("byte_bpe", cleared(encode_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Near duplicates, suffix sorting and byte pair encoding are beyond SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None
