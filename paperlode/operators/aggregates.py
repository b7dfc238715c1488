"""Aggregations over papers, tokens and loads."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, functions as F

from paperlode.functions.resources import tex_score
from paperlode.operators.filters import main_tex_candidates


def value_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def missing_count(all_ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    missing = all_ids.select(key).join(known.select(key), key, "left_anti")
    return missing.agg(F.count("*").alias("missing"))


def load_counts(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The table, and an observation that holds ``rows`` once an action has run on it."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def concat_text(df: DataFrame, by: str, col: str, sep: str = " ") -> DataFrame:
    """Texts of small groups joined in text order."""
    return df.groupBy(by).agg(
        F.expr(f"listagg({col}, '{sep}') WITHIN GROUP (ORDER BY {col})").alias(col)
    )


def main_tex(files: DataFrame) -> DataFrame:
    """The best main file per paper: most markers, then the later path."""
    scored = main_tex_candidates(files).withColumn("score", tex_score(F.col("text")))
    return scored.groupBy("paper_id").agg(
        F.max_by("path", F.struct("score", "path")).alias("path")
    )


def papers_without_main_tex(files: DataFrame) -> DataFrame:
    found = main_tex_candidates(files).select("paper_id").distinct()
    return files.select("paper_id").distinct().join(found, "paper_id", "left_anti")


def mean_pool(tokens: DataFrame, doc: str, vector: str = "embedding", mask: str = "mask") -> DataFrame:
    """Mean of a document's token vectors whose mask is 1 (zero vector when none is).

    Whole vectors are added up, in every task before the one shuffle, so a document with very
    many tokens sends one row per task.
    """
    weight = F.col(mask).cast("double")
    masked = array_to_vector(F.transform(vector, lambda x: x.cast("double") * weight))
    sums = tokens.groupBy(doc).agg(Summarizer.sum(masked).alias("_sum"), F.sum(weight).alias("_n"))
    mean = F.transform(vector_to_array("_sum"), lambda x: x / F.greatest(F.col("_n"), F.lit(1e-9)))
    return sums.select(doc, mean.alias(vector))


def first_pool(tokens: DataFrame, doc: str, position: str = "position", vector: str = "embedding") -> DataFrame:
    """The vector of a document's first token."""
    return tokens.groupBy(doc).agg(F.min_by(vector, position).alias(vector))


def pool(tokens: DataFrame, doc: str, strategy: str = "mean", **columns: str) -> DataFrame:
    if strategy == "mean":
        return mean_pool(tokens, doc, **columns)
    if strategy == "cls":
        return first_pool(tokens, doc, **columns)
    raise ValueError(f"unknown pooling strategy: {strategy}")
