"""Registered queries from query text to hits, with a user's batch function, and in display order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlode.operators import embedding
from paperlode.operators.aggregates import pool
from paperlode.plans.registered.vectors import HASHED_SQL, WHERE, _WHERE_SQL, _cells, vectors
from paperlode.plans.registered.views import PAPERS_SQL, QUERY_CELLS_SQL, as_papers, knn_sql, label_queries, papers, table, texts
from paperlode.plans.search import search_display, search_semantic, search_source_text
from paperlode.session import settle

YEARS = ["2003", "2004", "2011", "2019"]
SINCE = "2010-01-01"
DIM = 64


def term_hashing() -> Callable[[np.ndarray], np.ndarray]:
    """A user's embedding: made once per Python worker, then given batches of texts."""
    word = regex.compile(r"[\p{L}\p{N}_]{2,}")

    def predict(batch: np.ndarray) -> np.ndarray:
        out = np.zeros((len(batch), DIM), dtype=np.float64)
        for row, text in zip(out, batch, strict=True):
            for term in word.findall(str(text).lower()):
                row[int(hashlib.md5(term.encode()).hexdigest()[:7], 16) % DIM] += 1
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0).astype(np.float32)

    return predict


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with vectors of their abstracts, stored once."""
    view = as_papers(texts(spark, sf_dir)).select(
        "id", "title", "abstract", "url", "authors", "update_date", "year", "venue"
    )
    return settle(embedding.embed(view, "abstract"), "papers")


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def source_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From comma-separated texts to papers of the newest part of one source."""
    options = {"make_fn": term_hashing, "batch_size": 64}
    found = search_source_text(
        _embedded(spark, sf_dir), "arxiv", _spoken(spark, sf_dir), 10, embedding=options, since=SINCE
    )
    return found.select("query_id", "rank", "title", "url", "author")


def source_search_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anthology branch: years from a list, own columns, ``NONE`` where there is no author."""
    view = _embedded(spark, sf_dir).withColumn("author", F.when(F.col("id") % 4 != 0, F.col("authors")))
    found = search_source_text(view, "acl", _spoken(spark, sf_dir), 10, years=YEARS)
    return found.select("query_id", "rank", "title", "url", "author")


def embed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the user's batch function."""
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return _cells(embedding.embed(docs, "text", make_fn=term_hashing), "doc_id", "embedding")


def semantic_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    view = papers(spark, sf_dir).select(F.col("id").alias("vec_id"), "year", "venue")
    found = search_display(search_semantic(docs, view, label_queries(docs), WHERE, 20))
    return found.select("query_id", "position", "vec_id", "year", "score")


def pooled_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pooling strategies, chosen by name."""
    tokens = vectors(spark, sf_dir).select(
        "label", "embedding", F.col("vec_id").alias("position"), (F.col("vec_id") % 2).alias("mask")
    )
    both = [
        _cells(pool(tokens, "label", name), "label", "embedding").withColumn("strategy", F.lit(name))
        for name in ("mean", "cls")
    ]
    return both[0].unionByName(both[1])


QUERIES = {
    "source_search_text": source_search_text,
    "source_search_acl": source_search_acl,
    "embed_batch": embed_batch,
    "semantic_display": semantic_display,
    "pooled_choice": pooled_choice,
}

_SPOKEN_SQL = r"""
spoken AS (SELECT item_id AS query_id, array_to_string(list_transform(string_split(text, ','),
  lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), ' ') AS query FROM benchmark),
qtok AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]{2,}')) AS term FROM spoken),
qhits AS (SELECT query_id, ('0x' || substr(md5(term), 1, 7))::BIGINT % 64 AS pos, count(*) AS n FROM qtok GROUP BY ALL),
qlens AS (SELECT query_id, sqrt(sum(n * n)) AS len FROM qhits GROUP BY query_id),
qvecs AS (
  SELECT s.query_id, list(coalesce((n / len)::FLOAT, 0)::DOUBLE ORDER BY p.pos) AS q
  FROM spoken s CROSS JOIN (SELECT unnest(range(64)) AS pos) p
  LEFT JOIN qhits h ON h.query_id = s.query_id AND h.pos = p.pos LEFT JOIN qlens l ON l.query_id = s.query_id
  GROUP BY s.query_id),
dvecs AS (SELECT doc_id, list(x ORDER BY pos) AS d FROM hashed GROUP BY doc_id)"""


def _source_sql(where: str, k: int) -> str:
    return f"""
WITH {PAPERS_SQL}, {HASHED_SQL}, {_SPOKEN_SQL},
pairs AS (
  SELECT query_id, doc_id, round(CASE WHEN list_sum(list_transform(d, lambda x: abs(x))) = 0
      OR list_sum(list_transform(q, lambda x: abs(x))) = 0 THEN 0.0::DOUBLE
    ELSE list_cosine_similarity(d, q) END, 6) + 0.0::DOUBLE AS score
  FROM qvecs, dvecs JOIN papers ON id = doc_id WHERE {where}),
best AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM pairs QUALIFY rank <= {k})"""


ORACLES = {
    "source_search_text": _source_sql(f"update_date >= '{SINCE}'", 10) + """
SELECT query_id, rank, '[' || id || '] ' || coalesce(title, 'NONE') AS title, url, authors AS author
FROM best JOIN papers ON id = doc_id""",
    "source_search_acl": _source_sql(f"year IN ({', '.join(YEARS)})", 10) + """
SELECT query_id, rank, title, url, CASE WHEN id % 4 <> 0 THEN authors ELSE 'NONE' END AS author
FROM best JOIN papers ON id = doc_id""",
    "embed_batch": f"WITH {HASHED_SQL} SELECT doc_id, pos, round(x, 6) AS x FROM hashed",
    "semantic_display": f"""
WITH {PAPERS_SQL}, {QUERY_CELLS_SQL}, hits AS ({knn_sql("l2", 100)}),
kept AS (SELECT query_id, doc_id AS vec_id, year, score FROM hits JOIN papers ON id = doc_id WHERE {_WHERE_SQL}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20),
scored AS (SELECT query_id, vec_id, year, round(1 + score / sqrt(2.0::DOUBLE), 6) AS score FROM kept)
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY year DESC, score DESC, vec_id) - 1)::INTEGER AS position
FROM scored""",
    "pooled_choice": """
WITH cells AS (SELECT label, vec_id % 2 AS mask, unnest(embedding)::DOUBLE AS x,
  unnest(range(len(embedding))) AS pos FROM embeddings),
first AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label)
SELECT label, pos, round(sum(x * mask) / greatest(sum(mask), 1e-9::DOUBLE), 6) AS x, 'mean' AS strategy
FROM cells GROUP BY label, pos
UNION ALL SELECT label, unnest(range(len(e))), round(unnest(e)::DOUBLE, 6), 'cls' FROM first""",
}
