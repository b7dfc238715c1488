"""Registered queries on terms and keyword ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlode.functions.text import TERM_PATTERN, plural_stem
from paperlode.operators import bm25, terms
from paperlode.operators.joins import join_hits
from paperlode.plans.registered.views import (
    PAPERS_SQL,
    as_papers,
    bm25_sql,
    papers,
    table,
    texts,
    tokens_sql,
)
from paperlode.plans.search import search_bm25, search_index
from paperlode.session import scratch_path, settle

KEYWORDS = "tion sted que unglich thatin, tion from"
RARE = "notfound, sted"
VENUES = [f"src{i}" for i in range(12)]
_ONE = f"SELECT 0 AS query_id, '{KEYWORDS}' AS text"
_STEM_SQL = (
    "CASE WHEN regexp_matches(term, '[^ae]ies$') THEN regexp_replace(term, 'ies$', 'y') "
    "WHEN regexp_matches(term, '[aeio]es$|[us]s$|^.{1,2}$') THEN term "
    "ELSE regexp_replace(term, 's$', '') END"
)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.bm25_topk(texts(spark, sf_dir), "doc_id", "text", KEYWORDS, 100)


def bm25_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bm25")
    bm25.write_index(bm25.bm25_index(texts(spark, sf_dir), "doc_id", "text"), path)
    return bm25.bm25_search(bm25.read_index(spark, path), KEYWORDS, 100)


def bm25_rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.score_docs(texts(spark, sf_dir), "text", KEYWORDS).select("doc_id", "score")


def bm25_index_rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.bm25_rank_all(bm25.bm25_index(texts(spark, sf_dir), "doc_id", "text"), KEYWORDS)


def bm25_rank_all_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = as_papers(texts(spark, sf_dir))
    found = search_bm25(view, KEYWORDS, 50, VENUES, 2005, 2020, text="abstract")
    return found.select("id", "title", "venue", "year", "score")


def bm25_search_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all abstracts is stored once; the search reads it and the paper table."""
    view = settle(as_papers(texts(spark, sf_dir)), "papers")
    path = scratch_path(spark, "bm25")
    bm25.write_index(bm25.bm25_index(view, "id", "abstract"), path)
    found = search_index(bm25.read_index(spark, path), view, KEYWORDS, 50, VENUES, 2005, 2020)
    return found.select("id", "title", "venue", "year", "score")


def bm25_search_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles are short, so few of them have a term and others fill up the list."""
    view = settle(as_papers(texts(spark, sf_dir)), "papers")
    index = bm25.bm25_index(view, "id", "title")
    found = search_index(index, view, RARE, 400, VENUES[:3], None, 2010)
    return found.select("id", "title", "venue", "year", "score")


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = bm25.bm25_index(texts(spark, sf_dir), "doc_id", "text")
    return bm25.bm25_batch(index, questions, 10).select("query_id", "rank", "doc_id", "score")


def bm25_title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = papers(spark, sf_dir).select("id", "title")
    hits = bm25.bm25_topk(view, "id", "title", KEYWORDS, 200).withColumnRenamed("doc_id", "hit_id")
    named = hits.join(view.select(F.col("id").alias("hit_id"), F.col("title").alias("text")), "hit_id")
    return join_hits(view, named, ("title", "text")).select("id", "title", "hit_id", "score")


def bm25_snorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bm25.bm25_index(texts(spark, sf_dir), "doc_id", "text", plural_stem)
    return bm25.bm25_search(index, KEYWORDS, 100, plural_stem)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.normalize_vocab(terms.tokenize(texts(spark, sf_dir), "doc_id", "text"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequency(texts(spark, sf_dir), "text")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.corpus_stats(texts(spark, sf_dir), "doc_id", "text")


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = terms.length_stats(texts(spark, sf_dir), "doc_id", "text")
    return stats.withColumn("avg_len", F.round("avg_len", 6))


_ALL = bm25_sql("documents", "doc_id", "text", _ONE)
_TOP = f"WITH {_ALL} SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 100"
_FULL = (
    f"WITH {_ALL} SELECT d.doc_id, coalesce(score, 0)::DOUBLE AS score "
    "FROM documents d LEFT JOIN scores s USING (doc_id)"
)

_FILTERED = f"""
WITH {PAPERS_SQL}, {bm25_sql("papers", "id", "abstract", _ONE)}
SELECT id, title, venue, year, coalesce(score, 0)::DOUBLE AS score
FROM papers LEFT JOIN scores ON doc_id = id
WHERE venue IN ({", ".join(f"'{v}'" for v in VENUES)}) AND year BETWEEN 2005 AND 2020
ORDER BY score DESC, id LIMIT 50"""

QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_index_search": bm25_index_search,
    "bm25_rank_all": bm25_rank_all,
    "bm25_index_rank_all": bm25_index_rank_all,
    "bm25_rank_all_filtered": bm25_rank_all_filtered,
    "bm25_search_papers": bm25_search_papers,
    "bm25_search_fill": bm25_search_fill,
    "bm25_batch": bm25_batch,
    "bm25_title_join": bm25_title_join,
    "bm25_snorm": bm25_snorm,
    "vocabulary": vocabulary,
    "term_frequency": term_frequency,
    "corpus_stats": corpus_stats,
    "length_stats": length_stats,
}

ORACLES = {
    "bm25_topk": _TOP,
    "bm25_index_search": _TOP,
    "bm25_rank_all": _FULL,
    "bm25_index_rank_all": _FULL,
    "bm25_rank_all_filtered": _FILTERED,
    "bm25_search_papers": _FILTERED,
    "bm25_search_fill": f"""
WITH {PAPERS_SQL}, {bm25_sql("papers", "id", "title", f"SELECT 0 AS query_id, '{RARE}' AS text")}
SELECT id, title, venue, year, coalesce(score, 0)::DOUBLE AS score
FROM papers LEFT JOIN scores ON doc_id = id
WHERE venue IN ({", ".join(f"'{v}'" for v in VENUES[:3])}) AND year <= 2010
ORDER BY score DESC, id LIMIT 400""",
    "bm25_batch": f"""
WITH {bm25_sql("documents", "doc_id", "text", "SELECT item_id AS query_id, text FROM benchmark")}
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)
WHERE rank <= 10""",
    "bm25_title_join": f"""
WITH {PAPERS_SQL}, {bm25_sql("papers", "id", "title", _ONE)},
hits AS (SELECT doc_id AS hit_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 200)
SELECT p.id, p.title, hit_id, score
FROM hits JOIN papers h ON h.id = hit_id JOIN papers p ON p.title = h.title""",
    "bm25_snorm": f"""
WITH {bm25_sql("documents", "doc_id", "text", _ONE, _STEM_SQL)}
SELECT doc_id, score FROM scores ORDER BY score DESC, doc_id LIMIT 100""",
    "vocabulary": f"""
WITH tok AS (SELECT unnest(regexp_extract_all(lower(text), '{TERM_PATTERN}')) AS term FROM documents)
SELECT DISTINCT term, {_STEM_SQL} AS norm FROM tok""",
    "term_frequency": f"""
WITH tok AS ({tokens_sql("documents", "doc_id", "text", "doc_id")}),
top AS (SELECT term, count(*) AS freq FROM tok GROUP BY term ORDER BY freq DESC, term LIMIT 200)
SELECT term, freq, round(freq / (SELECT max(freq) FROM top), 6) AS weight FROM top""",
    "corpus_stats": f"""
WITH tok AS ({tokens_sql("documents", "doc_id", "text", "doc_id")})
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term""",
    "length_stats": f"""
WITH tok AS ({tokens_sql("documents", "doc_id", "text", "doc_id")})
SELECT n_docs, total_len, round(total_len / n_docs, 6) AS avg_len FROM
  (SELECT count(*) AS n_docs FROM documents), (SELECT count(*) AS total_len FROM tok)""",
}
