"""Registered queries on what can be told of results that SQL cannot repeat: trained cells and
codes, and random ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec, functions as F

from paperlode.functions.vectors import l2sq
from paperlode.operators.ids import with_uuid
from paperlode.operators.knn import knn
from paperlode.plans.registered.vectors import ivf_kmeans, ivf_pq, pq_trained, vectors
from paperlode.plans.registered.views import label_queries, table
from paperlode.session import settle

K = 20
#: Of the exact K nearest, the share that a variant has to find. Codes of vectors without structure lose
#: much; theirs is a multiple of what chance finds (K of 500 vectors or more).
FLOORS = {"ivf_kmeans": 0.5, "pq_knn": 0.1, "ivf_pq": 0.1}


def approximate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each trained variant: its hits, whether ranks and scores go together, whether no hit
    stands twice, whether exact scores are exact, and whether it finds the share that it should."""
    docs = vectors(spark, sf_dir)
    queries = settle(label_queries(docs), "queries")
    exact = settle(knn(docs, queries, "l2", K).select("query_id", "doc_id", F.lit(1).alias("true")), "exact")
    found = []
    for name, query in (("ivf_kmeans", ivf_kmeans), ("pq_knn", pq_trained), ("ivf_pq", ivf_pq)):
        hits = settle(query(spark, sf_dir), "hits")
        told = hits.join(docs, hits["doc_id"] == docs["vec_id"]).join(queries, "query_id")
        told = told.join(exact, ["query_id", "doc_id"], "left")
        better = F.lag("score").over(_by_rank())
        told = told.withColumn("falls", F.coalesce(better >= F.col("score"), F.lit(True)))
        gap = F.abs(F.col("score") + l2sq(F.col("embedding"), F.col("query_vec")))
        found.append(
            told.agg(
                F.count("*").alias("hits"),
                F.min("falls").alias("ordered"),
                (F.count_distinct("query_id", "doc_id") == F.count("*")).alias("apart"),
                (F.lit(name != "ivf_kmeans") | (F.max(gap) < 1e-5)).alias("exact_scores"),
                (F.sum("true") >= FLOORS[name] * F.count("*")).alias("enough"),
            ).select(F.lit(name).alias("variant"), "*")
        )
    return reduce(DataFrame.unionByName, found)


def _by_rank() -> WindowSpec:
    return Window.partitionBy("query_id").orderBy("rank")


def random_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random ids are written once, tell rows apart and are read the same again."""
    rows = settle(with_uuid(table(spark, sf_dir, "documents").select("doc_id")), "uuids")
    again = rows.join(rows.select("doc_id", F.col("uuid").alias("other")), "doc_id")
    return again.agg(
        F.count("*").alias("rows"),
        (F.count_distinct("uuid") == F.count("*")).alias("apart"),
        F.min(F.col("uuid") == F.col("other")).alias("stored"),
        F.min(F.length("uuid")).alias("length"),
    )


QUERIES = {"approximate_facts": approximate_facts, "random_facts": random_facts}

ORACLES = {
    "approximate_facts": " UNION ALL ".join(
        f"SELECT '{name}' AS variant, {K} * (SELECT count(DISTINCT label) FROM embeddings) AS hits, "
        "true AS ordered, true AS apart, true AS exact_scores, true AS enough"
        for name in FLOORS
    ),
    "random_facts": "SELECT count(*) AS rows, true AS apart, true AS stored, 36 AS length FROM documents",
}
