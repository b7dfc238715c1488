"""Whole searches: keyword, semantic, per source, and the ranked report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from paperlode.functions.text import author_string, iso_date, paper_url, query_text, title_with_id
from paperlode.functions.vectors import relevance
from paperlode.operators.bm25 import Bm25Index, bm25_search, score_docs
from paperlode.operators.columns import fill_none
from paperlode.operators.embedding import embed
from paperlode.operators.filters import apply_defaults, category_prefix, recent_only
from paperlode.operators.knn import cosine_search, knn, knn_postfilter
from paperlode.operators.ranking import rerank, top_n_display
from paperlode.session import settle


def query_vectors(queries: DataFrame, text: str = "text", **embedding) -> DataFrame:
    """``query_id``, ``query_vec`` from comma-separated query texts."""
    spoken = queries.select("query_id", query_text(F.col(text)).alias("_text"))
    return embed(spoken, "_text", out="query_vec", **embedding).select("query_id", "query_vec")


def search_bm25(
    papers: DataFrame,
    query: str,
    n: int,
    venues: list[str] | None = None,
    start: int | None = None,
    end: int | None = None,
    text: str = "title",
    key: str = "id",
) -> DataFrame:
    """Keyword search over every paper, narrowed by venue and year, best n in display order.

    Statistics come from the whole table; the venue and year filters reach the scoring scan.
    """
    scored = apply_defaults(score_docs(papers, text, query), venues, start, end)
    return top_n_display(scored, n, tie=key)


def search_index(
    index: Bm25Index,
    papers: DataFrame,
    query: str,
    n: int,
    venues: list[str] | None = None,
    start: int | None = None,
    end: int | None = None,
    key: str = "id",
) -> DataFrame:
    """``search_bm25`` on a stored index: papers, narrowed by venue and year, are looked up among
    the postings of the query's terms, and no text is read. Papers without any of the terms
    fill up the list, by id, while it has fewer than n."""
    allowed = apply_defaults(papers, venues, start, end)
    ids = allowed.select(F.col(key).alias("doc_id"))
    hits = settle(bm25_search(index, query, n, among=ids), "hits")
    lacking = n - hits.count()
    if lacking > 0:
        others = ids.join(hits, "doc_id", "left_anti").orderBy("doc_id").limit(lacking)
        hits = settle(hits.unionByName(others.withColumn("score", F.lit(0.0))), "hits")
    found = allowed.join(F.broadcast(hits.withColumnRenamed("doc_id", "_hit")), F.col(key) == F.col("_hit"))
    return top_n_display(found.drop("_hit"), n, tie=key)


def search_semantic(
    docs: DataFrame,
    papers: DataFrame,
    queries: DataFrame,
    where: Mapping[str, object],
    n: int,
    key: str = "vec_id",
) -> DataFrame:
    """Vector search with the filter after it; scores are relevances."""
    hits = knn_postfilter(docs, papers, queries, where, n, key=key)
    return hits.withColumn("score", F.round(relevance(-F.col("score")), 6))


def search_display(hits: DataFrame, tie: str = "vec_id") -> DataFrame:
    """Hits of a vector search with ``position``, from 0 per query, as they are shown: newest
    first and best first within a year."""
    shown = Window.partitionBy("query_id").orderBy(F.desc("year"), F.desc("score"), F.asc(tie))
    return hits.withColumn("position", F.row_number().over(shown) - 1)


def _newest(papers: DataFrame, source: str, years: list[str], since: str) -> DataFrame:
    if source == "acl":
        return papers.filter(F.col("year").cast("string").isin(years))
    if source == "arxiv":
        return papers.filter(F.col("update_date") >= since)
    raise ValueError(f"unknown source: {source}")


def search_source(
    papers: DataFrame,
    source: str,
    queries: DataFrame,
    k: int,
    years: list[str] = ["2023", "2024"],
    since: str = "2022-01-01",
    key: str = "id",
) -> DataFrame:
    """Cosine search in the newest part of one source: ``query_id``, ``rank``, ``title``,
    ``url``, ``author``, ``abstract`` with ``NONE`` for missing values. ``papers`` carries
    its vectors in ``embedding``."""
    newest = _newest(papers, source, years, since)
    hits = cosine_search(newest, queries, k, id_col=key)
    found = newest.drop("embedding").join(hits, F.col(key) == F.col("doc_id"))
    if source == "arxiv":
        text_id = F.col(key).cast("string")
        found = found.withColumns(
            {"url": paper_url(text_id, "www"), "title": title_with_id(text_id, F.col("title"))}
        ).withColumnRenamed("authors", "author")
    return fill_none(found.select("query_id", "rank", "title", "url", "author", "abstract"))


def search_source_text(
    papers: DataFrame,
    source: str,
    queries: DataFrame,
    k: int,
    text: str = "text",
    embedding: Mapping[str, object] | None = None,
    **options,
) -> DataFrame:
    """``search_source`` from comma-separated query texts (``query_id``, ``text``): they become
    vectors in the same plan, by the user's batch function if ``embedding`` names one, and must
    be made like the papers' vectors."""
    return search_source(papers, source, query_vectors(queries, text, **(embedding or {})), k, **options)


def search_report(
    docs: DataFrame,
    papers: DataFrame,
    queries: DataFrame,
    as_of: str,
    depth: int = 200,
    metric: str = "ip",
    prefix: str = "cs.",
    key: str = "int_id",
    id_col: str = "vec_id",
) -> DataFrame:
    """Report rows: nearest ``depth`` papers per query, then only recent ones with a category
    starting with ``prefix``, ranked again from 0 in hit order."""
    hits = knn(docs, queries, metric, depth, id_col=id_col).select("query_id", "doc_id", "rank")
    wanted = category_prefix(recent_only(papers, "update_date", as_of), prefix)
    kept = rerank(wanted.join(hits, F.col(key) == F.col("doc_id")))
    return kept.select(
        "query_id",
        "rank",
        "arxiv_id",
        iso_date(F.try_to_date("update_date", "yyyy-MM-dd")).alias("update_date"),
        "title",
        "abstract",
        author_string(F.col("authors_parsed")).alias("authors"),
        paper_url(F.col("arxiv_id")).alias("url"),
    )
