"""Retrieval quality: reciprocal rank, nDCG and recall.

Only judged queries count; a judged query without hits scores 0. Hits are ranked by score,
then by lower document id.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlode.operators.ranking import rank_hits
from paperlode.session import settle

# Cut-offs of nDCG and recall.
CUTOFFS = [5, 10, 20, 50, 100]
METRIC_NAMES = ["RR", *[f"nDCG@{k}" for k in CUTOFFS], *[f"R@{k}" for k in CUTOFFS]]


def _dcg(gain: str, rank: str, k: int) -> Column:
    discounted = F.col(gain) / F.log2(F.col(rank) + F.lit(1.0))
    return F.sum(F.when(F.col(rank) <= k, discounted))


def per_query(
    qrels: DataFrame, run: DataFrame, cutoffs: Sequence[int] = CUTOFFS, variants: DataFrame | None = None
) -> DataFrame:
    """All metrics per judged query, one column each. With ``variants`` (the columns that tell runs
    apart, a row for each run) ``run`` holds several runs, and all are ranked, judged and added up
    together, by variant and query."""
    by = variants.columns if variants is not None else []
    judged = qrels.filter("relevance > 0")
    found = (
        rank_hits(run.select(*by, "query_id", "doc_id", "score"), [*by, "query_id"])
        .join(judged, ["query_id", "doc_id"])
        .groupBy(*by, "query_id")
        .agg(
            F.min("rank").alias("first"),
            *[_dcg("relevance", "rank", k).alias(f"dcg{k}") for k in cutoffs],
            *[F.count_if(F.col("rank") <= k).alias(f"hits{k}") for k in cutoffs],
        )
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.asc("doc_id"))
    ideal = (
        judged.withColumn("best", F.row_number().over(best))
        .filter(F.col("best") <= max(cutoffs))
        .groupBy("query_id")
        .agg(*[_dcg("relevance", "best", k).alias(f"ideal{k}") for k in cutoffs])
    )
    wanted = qrels.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("wanted"))
    asked = wanted.join(ideal, "query_id", "left")
    if variants is not None:  # a run is judged on every query, also where it has no hit
        names = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in variants.collect()])
        asked = asked.select("*", F.inline(names))
    joined = asked.join(found, [*by, "query_id"], "left")
    zero = F.lit(0.0)
    return joined.select(
        *by,
        "query_id",
        F.coalesce(1.0 / F.col("first"), zero).alias("RR"),
        *[F.coalesce(F.col(f"dcg{k}") / F.col(f"ideal{k}"), zero).alias(f"nDCG@{k}") for k in cutoffs],
        *[
            F.coalesce(F.try_divide(F.col(f"hits{k}"), F.col("wanted")), zero).alias(f"R@{k}")
            for k in cutoffs
        ],
    )


def reciprocal_rank(qrels: DataFrame, run: DataFrame) -> DataFrame:
    return per_query(qrels, run).select("query_id", "RR")


def ndcg(qrels: DataFrame, run: DataFrame, k: int) -> DataFrame:
    return per_query(qrels, run, [k]).select("query_id", f"`nDCG@{k}`")


def recall(qrels: DataFrame, run: DataFrame, k: int) -> DataFrame:
    return per_query(qrels, run, [k]).select("query_id", f"`R@{k}`")


def mean_metrics(metrics: DataFrame, *by: str) -> DataFrame:
    """Mean of every metric column over the queries, in one row for each value of ``by``."""
    return metrics.groupBy(*by).agg(*[F.avg(f"`{name}`").alias(name) for name in METRIC_NAMES])


def evaluate(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """``metric``, ``value``: the eleven means."""
    wide = mean_metrics(per_query(qrels, run))
    return wide.unpivot([], [f"`{name}`" for name in METRIC_NAMES], "metric", "value")


def compare_variants(qrels: DataFrame, runs: Mapping[tuple[str, int], DataFrame]) -> DataFrame:
    """One row per variant (index type, n_list) with all metric means. The runs are put together
    and scored in one pass over (variant, query)."""
    marked = [
        run.select(F.lit(kind).alias("index_type"), F.lit(n_list).alias("n_list"), "query_id", "doc_id", "score")
        for (kind, n_list), run in runs.items()
    ]
    every = reduce(DataFrame.unionByName, marked)
    variants = qrels.sparkSession.createDataFrame(list(runs), "index_type STRING, n_list INT")
    means = mean_metrics(per_query(qrels, every, variants=variants), "index_type", "n_list")
    return means.orderBy("index_type", "n_list")


def timed_variants(
    qrels: DataFrame, searches: Mapping[tuple[str, int], Callable[[], DataFrame]]
) -> DataFrame:
    """Runs the search of every variant, stores its run, and compares the stored runs; adds the
    wall time of each search in seconds."""
    runs, seconds = {}, []
    for (kind, n_list), search in searches.items():
        start = time.perf_counter()
        runs[kind, n_list] = settle(search().select("query_id", "doc_id", "score"), "run")
        seconds.append((kind, n_list, time.perf_counter() - start))
    times = qrels.sparkSession.createDataFrame(seconds, "index_type STRING, n_list INT, seconds DOUBLE")
    return compare_variants(qrels, runs).join(times, ["index_type", "n_list"])
