"""Ranks, top-n and sorted output. Ties are broken by the id columns given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Parts that the hits of one group are merged in.
MERGES = 64


def rank_hits(
    hits: DataFrame, by: str | list[str] = "query_id", score: str = "score", tie: str = "doc_id"
) -> DataFrame:
    """Adds ``rank``, counted from 1, per query."""
    window = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return hits.withColumn("rank", F.row_number().over(window))


def rerank(hits: DataFrame, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """Closes the gaps a filter left: ranks 0, 1, ... per query in the old order."""
    window = Window.partitionBy(by).orderBy(rank)
    return hits.withColumn(rank, F.row_number().over(window) - 1)


def top_k_per(
    hits: DataFrame, by: str | list[str] = "query_id", score: str = "score", k: int = 10, tie: str = "doc_id"
) -> DataFrame:
    """The k best rows of every group, with their rank. Each task keeps only its own k best
    rows of a group before the shuffle."""
    return rank_hits(hits, by, score, tie).filter(F.col("rank") <= k)


def merged_top_k(
    hits: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id"
) -> DataFrame:
    """``top_k_per`` for hits of very many tasks: the hits of a group are cut in ``MERGES`` parts
    first, by the task they come from, and what is left of them a second time, so the last cut
    sees at most ``MERGES * k`` rows of a group however many tasks there were."""
    parts = hits.withColumn("_part", F.spark_partition_id() % MERGES)
    first = top_k_per(parts, [by, "_part"], score, k, tie).drop("rank", "_part")
    return top_k_per(first, by, score, k, tie)


def top_n(df: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(tie)).limit(n)


def top_n_display(df: DataFrame, n: int, score: str = "score", year: str = "year", tie: str = "id") -> DataFrame:
    """The n best rows, newest first and best first within a year."""
    return top_n(df, score, n, tie).orderBy(F.desc(year), F.desc(score), F.asc(tie))


def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def sorted_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).orderBy(key)


def sort_desc(df: DataFrame, col: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(col), F.asc(tie))
