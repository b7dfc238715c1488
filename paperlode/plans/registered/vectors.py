"""Registered queries on vectors: exact and approximate search, pooling, embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlode.functions.vectors import cosine, dot, l2_normalize, relevance
from paperlode.operators import ann, embedding
from paperlode.operators.aggregates import first_pool, mean_pool
from paperlode.operators.knn import cosine_search, knn, pair_queries
from paperlode.plans.registered.views import (
    PAPERS_SQL,
    QUERY_CELLS_SQL,
    knn_sql,
    label_queries,
    papers,
    table,
    texts,
)
from paperlode.plans.search import search_semantic, search_source
from paperlode.session import scratch_path, settle

WHERE = {"$and": [{"year": {"$lt": 2020}}, {"year": {"$gte": 2005}}], "venue": {"$ne": "src3"}}
_WHERE_SQL = "year < 2020 AND year >= 2005 AND venue <> 'src3'"
_SLOTS = 8


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _cells(df: DataFrame, key: str, vector: str | Column) -> DataFrame:
    """One row per vector component, rounded to 6 places."""
    return df.select(key, F.posexplode_outer(vector).alias("pos", "x")).select(
        key, F.col("pos").cast("bigint").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x")
    )


def knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return knn(docs, label_queries(docs), "ip", 20)


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return cosine_search(docs, label_queries(docs), 20)


def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return knn(docs, label_queries(docs), "l2", 20)


def knn_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = knn_l2(spark, sf_dir)
    return hits.withColumn("relevance", F.round(relevance(-F.col("score")), 6))


def _with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = papers(spark, sf_dir).select("id", "year", "venue")
    return vectors(spark, sf_dir).join(view, F.col("vec_id") == F.col("id")).drop("id")


def knn_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(_with_metadata(spark, sf_dir), label_queries(vectors(spark, sf_dir)), "l2", 20, WHERE)


def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    view = papers(spark, sf_dir).select(F.col("id").alias("vec_id"), "year", "venue")
    found = search_semantic(docs, view, label_queries(docs), WHERE, 20)
    return found.select("query_id", "vec_id", "year", "venue", "score", "rank")


def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    means = label_queries(docs).select(F.col("query_id").cast("int").alias("label"), "query_vec")
    return docs.join(means, "label").select(
        "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("query_vec")), 6).alias("cosine")
    )


def query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    pairs = pair_queries(docs, label_queries(docs))
    return pairs.select(
        "vec_id", "query_id", F.round(dot(F.col("embedding"), F.col("query_vec")), 6).alias("score")
    )


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the tokens of one document per label; every third is masked out."""
    return vectors(spark, sf_dir).select(
        "label", "embedding", F.col("vec_id").alias("position"), (F.col("vec_id") % 3 != 0).cast("int").alias("mask")
    )


def mean_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(mean_pool(_tokens(spark, sf_dir), "label"), "label", "embedding")


def first_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(first_pool(_tokens(spark, sf_dir), "label"), "label", "embedding")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("vec_id"))
    return _cells(vectors(spark, sf_dir).select("vec_id", l2_normalize(scaled).alias("unit")), "vec_id", "unit")


def _label_centroids(docs: DataFrame) -> DataFrame:
    return label_queries(docs).select(
        F.col("query_id").cast("int").alias("cell"), F.col("query_vec").alias("centroid")
    )


def ivf_fixed_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    centroids = settle(_label_centroids(docs), "centroids")
    assigned = ann.ivf_assign(docs, centroids)
    return ann.ivf_knn(assigned, label_queries(docs), centroids, 3, 20)


def _ivf_kmeans(spark: SparkSession, sf_dir: str, nprobe: int) -> DataFrame:
    docs = vectors(spark, sf_dir)
    centroids = ann.ivf_train(docs, 16)
    path = scratch_path(spark, "cells")
    ann.write_cells(ann.ivf_assign(docs, centroids), path)
    return ann.ivf_knn(spark.read.parquet(path), label_queries(docs), centroids, nprobe, 20)


def ivf_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf_kmeans(spark, sf_dir, 4)


def ivf_kmeans_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf_kmeans(spark, sf_dir, 16)


def ivf_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of cells, stored by cell; all cells are probed, so hits are those of a full scan."""
    docs = vectors(spark, sf_dir)
    centroids = ann.ivf_train_two_level(docs, 25)
    path = scratch_path(spark, "cells")
    ann.write_cells(ann.ivf_assign(docs, centroids), path)
    return ann.ivf_knn(spark.read.parquet(path), label_queries(docs), centroids, centroids.count(), 20)


def _label_codebook(docs: DataFrame) -> DataFrame:
    """The slices of the label means as code book; the label is the code."""
    width = F.size("query_vec") / _SLOTS
    slots = F.sequence(F.lit(0), F.lit(_SLOTS - 1))
    return label_queries(docs).select(
        F.explode(slots).alias("slot"), F.col("query_id").cast("int").alias("code"), "query_vec"
    ).select(
        "slot",
        "code",
        F.slice("query_vec", (F.col("slot") * width + 1).cast("int"), width.cast("int")).alias("centroid"),
    )


def pq_fixed_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    codebook = settle(_label_codebook(docs), "codebook")
    return ann.pq_knn(ann.pq_encode(docs, codebook), label_queries(docs), codebook, 20)


def pq_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    codebook = ann.pq_train(docs, 16, 64, 5)
    return ann.pq_knn(ann.pq_encode(docs, codebook), label_queries(docs), codebook, 20)


def ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    centroids = settle(_label_centroids(docs), "centroids")
    gaps = ann.residuals(ann.ivf_assign(docs, centroids), centroids)
    codebook = ann.pq_train(gaps, 16, 64, 5)
    coded = ann.pq_encode(gaps, codebook)
    return ann.pq_knn(coded, label_queries(docs), codebook, 20, centroids, 4)


def ivf_pq_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cells and a fixed code book, so that the hits can be told exactly."""
    docs = vectors(spark, sf_dir)
    centroids, codebook = settle(_label_centroids(docs), "centroids"), settle(_label_codebook(docs), "codebook")
    coded = ann.pq_encode(ann.residuals(ann.ivf_assign(docs, centroids), centroids), codebook)
    return ann.pq_knn(coded, label_queries(docs), codebook, 20, centroids, 3)


def embed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(embedding.embed(texts(spark, sf_dir), "text"), "doc_id", "embedding")


def embed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents are embedded first; a second run adds the others only."""
    path = scratch_path(spark, "vectors")
    docs = texts(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    embedding.index_update(docs.join(labels, "doc_id", "left_semi"), path, "doc_id", "text")
    embedding.index_update(docs, path, "doc_id", "text")
    stored = spark.read.parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + F.round(x.cast("double"), 6))
    return stored.select("doc_id", F.round(total, 6).alias("total"))


def source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    view = papers(spark, sf_dir).join(docs.select(F.col("vec_id").alias("id"), "embedding"), "id")
    found = search_source(view, "arxiv", label_queries(docs), 20, since="2010-01-01")
    return found.select("query_id", "rank", "title", "url", "author")


_KNN = f"WITH {QUERY_CELLS_SQL} "


def _cells_sql(n_list: int, mark: str = "") -> str:
    """Cell of every vector and probed cells of every query, for the first ``n_list`` centroids."""
    return f"""
near{mark} AS (
  SELECT vec_id, c.query_id AS cell, row_number() OVER (PARTITION BY vec_id
    ORDER BY round(pow(list_distance(v, c.query_vec), 2), 6), c.query_id) AS n
  FROM docs, queries c WHERE c.query_id < {n_list}),
probes{mark} AS (
  SELECT q.query_id, c.query_id AS cell, row_number() OVER (PARTITION BY q.query_id
    ORDER BY round(pow(list_distance(q.query_vec, c.query_vec), 2), 6), c.query_id) AS n
  FROM queries q, queries c WHERE c.query_id < {n_list})"""


def _cand_sql(mark: str = "") -> str:
    return f"""
cand{mark} AS (
  SELECT q.query_id, d.vec_id, round(-pow(list_distance(d.v, q.query_vec), 2), 6) + 0.0::DOUBLE AS score
  FROM docs d JOIN near{mark} USING (vec_id) JOIN probes{mark} p USING (cell) JOIN queries q ON q.query_id = p.query_id
  WHERE near{mark}.n = 1 AND p.n <= 3)"""


def _residual_sql(mark: str) -> str:
    """Scores of vectors coded by what is left of them after their cell's centroid."""
    return f"""
rest{mark} AS (
  SELECT c.vec_id, n.cell, c.pos, c.x - m.x AS x FROM cells c JOIN near{mark} n ON n.vec_id = c.vec_id AND n.n = 1
  JOIN means m ON m.query_id = n.cell AND m.pos = c.pos),
rest_gaps{mark} AS (
  SELECT r.vec_id, r.cell, r.pos // 8 AS slot, b.query_id AS code, sum((r.x - b.x) * (r.x - b.x)) AS d
  FROM rest{mark} r JOIN means b USING (pos) GROUP BY ALL),
rest_codes{mark} AS (
  SELECT vec_id, cell, slot, code FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id, slot ORDER BY round(d, 6), code) AS n FROM rest_gaps{mark})
  WHERE n = 1),
rest_tables{mark} AS (
  SELECT q.query_id, m.query_id AS cell, q.pos // 8 AS slot, b.query_id AS code,
    sum((q.x - m.x - b.x) * (q.x - m.x - b.x)) AS d
  FROM means q JOIN means m ON m.pos = q.pos JOIN means b ON b.pos = q.pos GROUP BY ALL),
cand_pq{mark} AS (
  SELECT t.query_id, vec_id, round(-sum(t.d), 6) + 0.0::DOUBLE AS score
  FROM rest_codes{mark} r JOIN probes{mark} p ON p.cell = r.cell AND p.n <= 3
  JOIN rest_tables{mark} t ON t.query_id = p.query_id AND t.cell = r.cell AND t.slot = r.slot AND t.code = r.code
  GROUP BY ALL)"""


_IVF = f"""
WITH {QUERY_CELLS_SQL}, {_cells_sql(1_000_000)}, {_cand_sql()}"""
_TOP_CAND = """
SELECT query_id, vec_id AS doc_id, score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cand)
WHERE rank <= 20"""
_PQ = f"""
WITH {QUERY_CELLS_SQL},
gaps AS (
  SELECT c.vec_id, c.pos // 8 AS slot, m.query_id AS code, sum((c.x - m.x) * (c.x - m.x)) AS d
  FROM cells c JOIN means m USING (pos) GROUP BY ALL),
codes AS (
  SELECT vec_id, slot, code FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id, slot ORDER BY round(d, 6), code) AS n FROM gaps)
  WHERE n = 1),
tables AS (
  SELECT q.query_id, q.pos // 8 AS slot, b.query_id AS code, sum((q.x - b.x) * (q.x - b.x)) AS d
  FROM means q JOIN means b USING (pos) GROUP BY ALL),
cand AS (
  SELECT query_id, vec_id, round(-sum(d), 6) + 0.0::DOUBLE AS score
  FROM codes JOIN tables USING (slot, code) GROUP BY ALL)"""

HASHED_SQL = r"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
hits AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 7))::BIGINT % 64 AS pos, count(*) AS n FROM tok GROUP BY ALL),
lens AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM hits GROUP BY doc_id),
hashed AS (
  SELECT d.doc_id, p.pos, coalesce((n / len)::FLOAT, 0)::DOUBLE AS x
  FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS pos) p
  LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.pos = p.pos LEFT JOIN lens l ON l.doc_id = d.doc_id)"""

QUERIES = {
    "knn_ip": knn_ip,
    "knn_cosine": knn_cosine,
    "knn_l2": knn_l2,
    "knn_relevance": knn_relevance,
    "knn_prefilter": knn_prefilter,
    "knn_postfilter": knn_postfilter,
    "pairwise_cosine": pairwise_cosine,
    "query_pairs": query_pairs,
    "mean_pool": mean_pooled,
    "first_pool": first_pooled,
    "l2_normalize": normalized,
    "ivf_fixed_centroids": ivf_fixed_centroids,
    "ivf_kmeans": ivf_kmeans,
    "ivf_kmeans_all_cells": ivf_kmeans_all_cells,
    "ivf_two_level": ivf_two_level,
    "pq_fixed_codebook": pq_fixed_codebook,
    "pq_knn": pq_trained,
    "ivf_pq": ivf_pq,
    "ivf_pq_fixed": ivf_pq_fixed,
    "embed_hashing": embed_hashing,
    "embed_incremental": embed_incremental,
    "source_search": source_search,
}

ORACLES = {
    "knn_ip": _KNN + knn_sql("ip", 20),
    "knn_cosine": _KNN + knn_sql("cosine", 20),
    "knn_l2": _KNN + knn_sql("l2", 20),
    "knn_relevance": f"""
WITH {QUERY_CELLS_SQL}, hits AS ({knn_sql("l2", 20)})
SELECT *, round(1 + score / sqrt(2.0::DOUBLE), 6) AS relevance FROM hits""",
    "knn_prefilter": f"""
WITH {PAPERS_SQL}, {QUERY_CELLS_SQL},
narrow AS (SELECT docs.* FROM docs JOIN papers ON id = vec_id WHERE {_WHERE_SQL})
{knn_sql("l2", 20, "narrow")}""",
    "knn_postfilter": f"""
WITH {PAPERS_SQL}, {QUERY_CELLS_SQL}, hits AS ({knn_sql("l2", 100)}),
kept AS (SELECT query_id, doc_id AS vec_id, year, venue, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM hits JOIN papers ON id = doc_id WHERE {_WHERE_SQL})
SELECT query_id, vec_id, year, venue, round(1 + score / sqrt(2.0::DOUBLE), 6) AS score, rank
FROM kept WHERE rank <= 20""",
    "pairwise_cosine": f"""
WITH {QUERY_CELLS_SQL}
SELECT vec_id, label, round(list_cosine_similarity(v, query_vec), 6) AS cosine
FROM docs JOIN queries ON query_id = label""",
    "query_pairs": f"""
WITH {QUERY_CELLS_SQL}
SELECT vec_id, query_id, round(list_dot_product(v, query_vec), 6) AS score FROM docs, queries""",
    "mean_pool": """
WITH cells AS (SELECT label, (vec_id % 3 <> 0)::INTEGER AS mask, unnest(embedding)::DOUBLE AS x,
  unnest(range(len(embedding))) AS pos FROM embeddings)
SELECT label, pos, round(sum(x * mask) / greatest(sum(mask), 1e-9::DOUBLE), 6) AS x FROM cells GROUP BY label, pos""",
    "first_pool": """
WITH first AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label)
SELECT label, unnest(range(len(e))) AS pos, round(unnest(e)::DOUBLE, 6) AS x FROM first""",
    "l2_normalize": """
WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE * vec_id AS x, unnest(range(len(embedding))) AS pos
               FROM embeddings),
norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM cells GROUP BY vec_id)
SELECT vec_id, pos, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) + 0.0::DOUBLE AS x FROM cells JOIN norms USING (vec_id)""",
    "ivf_fixed_centroids": _IVF + _TOP_CAND,
    "ivf_kmeans_all_cells": _KNN + knn_sql("l2", 20),
    "ivf_two_level": _KNN + knn_sql("l2", 20),
    "pq_fixed_codebook": _PQ + _TOP_CAND,
    "ivf_pq_fixed": f"""
WITH {QUERY_CELLS_SQL}, {_cells_sql(1_000_000)}, {_residual_sql("")}""" + _TOP_CAND.replace("FROM cand)", "FROM cand_pq)"),
    "embed_hashing": f"WITH {HASHED_SQL} SELECT doc_id, pos, round(x, 6) AS x FROM hashed",
    "embed_incremental": f"""
WITH {HASHED_SQL} SELECT doc_id, round(sum(round(x, 6)), 6) AS total FROM hashed GROUP BY doc_id""",
    "source_search": f"""
WITH {PAPERS_SQL}, {QUERY_CELLS_SQL},
narrow AS (SELECT docs.* FROM docs JOIN papers ON id = vec_id WHERE update_date >= '2010-01-01'),
hits AS ({knn_sql("cosine", 20, "narrow")})
SELECT query_id, rank, '[' || id || '] ' || coalesce(title, 'NONE') AS title, url, authors AS author
FROM hits JOIN papers ON id = doc_id""",
}
