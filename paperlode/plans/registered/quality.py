"""Registered queries on retrieval quality. A query stands for a label: the vectors with that
label are its relevant documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlode.operators import ann, evaluate
from paperlode.operators.joins import judged_hits
from paperlode.operators.knn import knn
from paperlode.plans.registered.vectors import (
    _PQ,
    _cand_sql,
    _cells_sql,
    _label_centroids,
    _label_codebook,
    _residual_sql,
    vectors,
)
from paperlode.plans.registered.views import QUERY_CELLS_SQL, knn_sql, label_queries
from paperlode.session import settle

CUTOFFS = evaluate.CUTOFFS
N_LISTS = (4, 7, 10)


def _qrels(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("label").cast("bigint").alias("query_id"), F.col("vec_id").alias("doc_id"), F.lit(1).alias("relevance")
    )


def _flat_run(docs: DataFrame) -> DataFrame:
    return knn(docs, label_queries(docs), "l2", 100).drop("rank")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(f"`{c}`", 6).alias(c.replace("@", "_")) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def metric_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return _rounded(evaluate.reciprocal_rank(_qrels(docs), _flat_run(docs)))


def metric_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return _rounded(evaluate.ndcg(_qrels(docs), _flat_run(docs), 10))


def metric_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return _rounded(evaluate.recall(_qrels(docs), _flat_run(docs), 50))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return _rounded(evaluate.evaluate(_qrels(docs), _flat_run(docs)))


def metric_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return _rounded(evaluate.per_query(_qrels(docs), _flat_run(docs)))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    hits = judged_hits(_qrels(docs), _flat_run(docs))
    return hits.select("query_id", "doc_id", "relevance", F.coalesce("score", F.lit(-99.0)).alias("score"))


def variant_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    queries = label_queries(docs)
    centroids = settle(_label_centroids(docs), "centroids")
    codebook = settle(_label_codebook(docs), "codebook")
    runs = {("Flat", 0): _flat_run(docs), ("PQ", 0): ann.pq_knn(ann.pq_encode(docs, codebook), queries, codebook, 100)}
    for n_list in N_LISTS:
        cells = centroids.filter(F.col("cell") < n_list)
        assigned = settle(ann.ivf_assign(docs, cells), "assigned")
        coded = ann.pq_encode(ann.residuals(assigned, cells), codebook)
        runs["IVFFlat", n_list] = ann.ivf_knn(assigned, queries, cells, 3, 100)
        runs["IVFPQ", n_list] = ann.pq_knn(coded, queries, codebook, 100, cells, 3)
    runs = {name: run.select("query_id", "doc_id", "score") for name, run in runs.items()}
    return _rounded(evaluate.compare_variants(_qrels(docs), runs))


QUERIES = {
    "metric_rr": metric_rr,
    "metric_ndcg": metric_ndcg,
    "metric_recall": metric_recall,
    "metric_per_query": metric_per_query,
    "metric_summary": metric_summary,
    "judged_hits": judged,
    "variant_compare": variant_compare,
}


def _per_query_sql(run: str) -> str:
    """A select of all metrics per query over a run (query_id, doc_id, score)."""
    parts = []
    for k in CUTOFFS:
        parts.append(
            f"coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0)"
            f" / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + {k}) r(i) WHERE i <= wanted) AS nDCG_{k}"
        )
        parts.append(f"coalesce(count(rank) FILTER (rank <= {k}), 0) / wanted AS R_{k}")
    return f"""
SELECT query_id, coalesce(1 / min(rank), 0)::DOUBLE AS RR, {", ".join(parts)} FROM
  (SELECT label::BIGINT AS query_id, count(*) AS wanted FROM embeddings GROUP BY label)
  LEFT JOIN (SELECT r.query_id, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({run})) r
    JOIN embeddings ON label = r.query_id AND vec_id = r.doc_id) USING (query_id)
GROUP BY query_id, wanted"""


_NAMES = ["RR", *[f"nDCG_{k}" for k in CUTOFFS], *[f"R_{k}" for k in CUTOFFS]]
_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES)
_MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in _NAMES)
_FLAT = f"WITH {QUERY_CELLS_SQL}, per AS ({_per_query_sql(knn_sql('l2', 100))}) "


_VARIANT_CELLS = ", ".join(
    f"{_cells_sql(n, f'_{n}')}, {_cand_sql(f'_{n}')}, {_residual_sql(f'_{n}')}" for n in N_LISTS
)
_VARIANTS = [("Flat", 0, knn_sql("l2", 100)), ("PQ", 0, "cand")]
_VARIANTS += [(kind, n, f"{name}_{n}") for n in N_LISTS for kind, name in (("IVFFlat", "cand"), ("IVFPQ", "cand_pq"))]


def _best_sql(source: str) -> str:
    if " " in source:
        return source
    return f"""SELECT query_id, vec_id AS doc_id, score FROM {source}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 100"""


ORACLES = {
    "metric_rr": _FLAT + "SELECT query_id, round(RR, 6) AS RR FROM per",
    "metric_ndcg": _FLAT + "SELECT query_id, round(nDCG_10, 6) AS nDCG_10 FROM per",
    "metric_recall": _FLAT + "SELECT query_id, round(R_50, 6) AS R_50 FROM per",
    "metric_per_query": _FLAT + f"SELECT query_id, {_ROUNDED} FROM per",
    "metric_summary": _FLAT
    + " UNION ALL ".join(
        f"SELECT '{n.replace('_', '@')}' AS metric, round(avg({n}), 6) AS value FROM per" for n in _NAMES
    ),
    "judged_hits": f"""
WITH {QUERY_CELLS_SQL}, hits AS ({knn_sql("l2", 100)})
SELECT label::BIGINT AS query_id, vec_id AS doc_id, 1 AS relevance, coalesce(score, -99.0)::DOUBLE AS score
FROM embeddings LEFT JOIN hits ON query_id = label AND doc_id = vec_id""",
    "variant_compare": f"{_PQ}, {_VARIANT_CELLS} "
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS index_type, {n} AS n_list, {_MEANS} FROM ({_per_query_sql(_best_sql(source))})"
        for kind, n, source in _VARIANTS
    ),
}
