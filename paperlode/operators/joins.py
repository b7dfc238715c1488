"""Joins between papers, ids, hits and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_hits(papers: DataFrame, hits: DataFrame, on: str | tuple[str, str] = "doc_id") -> DataFrame:
    """Papers with their hits. ``on`` may name a column per side; joining on a title keeps
    every paper that shares it."""
    left, right = (on, on) if isinstance(on, str) else on
    return papers.join(hits.withColumnRenamed(right, left), left, "inner")


def attach_int_ids(df: DataFrame, id_map: DataFrame, key: str, map_key: str = "arxiv_id") -> DataFrame:
    return df.join(id_map.withColumnRenamed(map_key, key), key, "left")


def new_rows(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones.

    The known keys are first cut down to those that occur in ``df``. When ``df`` is a stored
    load whose keys Spark finds small enough to broadcast, the known table is scanned for one
    column and not shuffled; otherwise both sides are joined on the key.
    """
    seen = known.select(key).join(df.select(key), key, "left_semi").distinct()
    return df.join(seen, key, "left_anti")


def known_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def in_hit_order(hits: DataFrame, papers: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """The hit papers in rank order, query by query where hits have a ``query_id``."""
    order = [c for c in ("query_id", rank) if c in hits.columns]
    return papers.join(hits, key, "inner").orderBy(*order)


def judged_hits(qrels: DataFrame, run: DataFrame) -> DataFrame:
    return qrels.join(run, ["query_id", "doc_id"], "left")


def map_ids(df: DataFrame, ids: DataFrame, cols: dict[str, str], key: str = "key") -> DataFrame:
    """Replace text ids by integers. ``cols`` maps a column to the side of the id table
    (``side``, ``key``, ``int_id``) its values belong to. A row whose id is unknown stays, with null."""
    for col, side in cols.items():
        lookup = ids.filter(F.col("side") == side).select(
            F.col(key).alias(col), F.col("int_id").alias(f"_{col}")
        )
        df = df.join(lookup, col, "left").drop(col).withColumnRenamed(f"_{col}", col)
    return df


def split_feedback(hits: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits whose position was marked relevant, and those marked irrelevant."""
    marked = hits.join(marks, ["query_id", "position"], "inner")
    return (
        marked.filter(F.col("label") == "relevant").drop("label"),
        marked.filter(F.col("label") == "irrelevant").drop("label"),
    )
