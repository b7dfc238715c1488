"""Registered queries on ranked reports, exports and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlode.operators.joins import in_hit_order, join_hits, split_feedback
from paperlode.operators.knn import knn
from paperlode.operators.report import export_json, markdown_report, report_catalog
from paperlode.plans.registered.vectors import vectors
from paperlode.plans.registered.views import PAPERS_SQL, QUERY_CELLS_SQL, knn_sql, label_queries, papers, table
from paperlode.plans.search import search_report

AS_OF = "2022-06-30"


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = vectors(spark, sf_dir)
    return knn(docs, label_queries(docs), "ip", k)


def search_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir)
    view = papers(spark, sf_dir).withColumn("arxiv_id", F.col("id").cast("string"))
    return search_report(docs, view, label_queries(docs), AS_OF, key="id")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_report(search_report_rows(spark, sf_dir))


def hit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir, 20).withColumnRenamed("doc_id", "id")
    return in_hit_order(hits, papers(spark, sf_dir).select("id", "title"), "id").select("query_id", "rank", "id", "title")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "benchmark").select(
        F.col("text").alias("query"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("item_id").cast("int")).alias("run_date")
    )
    return report_catalog(runs).select("path", "line")


def feedback_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir, 50).withColumn("position", F.col("rank") - 1).select("query_id", "position", "doc_id")
    marks = join_hits(table(spark, sf_dir, "labels"), hits).select(
        "query_id", "position", F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("label")
    )
    good, bad = split_feedback(hits, marks)
    return good.withColumn("mark", F.lit("relevant")).unionByName(bad.withColumn("mark", F.lit("irrelevant")))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = papers(spark, sf_dir).select(F.col("id").alias("doc_id"), "venue", "year")
    found = join_hits(view, _hits(spark, sf_dir, 20)).select("query_id", "rank", "doc_id", "venue", "year")
    return export_json(found, "query_id", "rank")


QUERIES = {
    "search_report": search_report_rows,
    "markdown_report": markdown,
    "hit_order": hit_order,
    "report_catalog": catalog,
    "feedback_split": feedback_split,
    "export_json": exported,
}

_REPORT = f"""
WITH {PAPERS_SQL}, {QUERY_CELLS_SQL}, hits AS ({knn_sql("ip", 200)}),
report AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1)::INTEGER AS rank,
    id::VARCHAR AS arxiv_id, update_date, title, abstract, author_string AS authors,
    'https://arxiv.org/abs/' || id AS url
  FROM hits JOIN papers ON id = doc_id
  WHERE try_strptime(update_date, '%Y-%m-%d') >= DATE '{AS_OF}' - 1825
    AND regexp_matches(categories, '(^|\\s)cs\\.'))"""

ORACLES = {
    "search_report": _REPORT + " SELECT * FROM report",
    "markdown_report": _REPORT + """
SELECT query_id, string_agg('**[' || (rank + 1) || '. [' || arxiv_id || '] ' || title || '](https://arxiv.org/pdf/'
  || arxiv_id || '.pdf)** (' || update_date || ')' || chr(10) || chr(10) || '*' || authors || '*' || chr(10) || chr(10)
  || abstract || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY rank) AS report
FROM report GROUP BY query_id""",
    "hit_order": f"""
WITH {PAPERS_SQL}, {QUERY_CELLS_SQL}, hits AS ({knn_sql("ip", 20)})
SELECT query_id, rank, id, title FROM hits JOIN papers ON id = doc_id ORDER BY rank""",
    "report_catalog": r"""
WITH runs AS (SELECT text AS query, strftime(DATE '2024-01-01' + item_id::INTEGER, '%Y%m%d') AS stamp FROM benchmark),
paths AS (SELECT *, stamp[1:4] || '/' || stamp[5:6] || '/' || stamp || '_' || lower(replace(query, ' ', '_')) || '.md' AS path
  FROM runs)
SELECT path, '- [' || array_to_string(list_transform(regexp_extract_all(query, '\p{L}+|[^\p{L}]+'),
  lambda r: CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END || lower(r[2:])), '') || ' (' || stamp || ')](' || path || ')' AS line FROM paths""",
    "feedback_split": f"""
WITH {QUERY_CELLS_SQL}, hits AS ({knn_sql("ip", 50)})
SELECT query_id, rank - 1 AS position, h.doc_id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS mark
FROM hits h JOIN labels l ON l.doc_id = h.doc_id""",
    "export_json": f"""
WITH {PAPERS_SQL}, {QUERY_CELLS_SQL}, hits AS ({knn_sql("ip", 20)})
SELECT query_id, '[' || string_agg('{{"rank":' || rank || ',"doc_id":' || doc_id || ',"venue":"' || venue || '","year":'
  || coalesce(year::VARCHAR, 'null') || '}}', ',' ORDER BY rank) || ']' AS records
FROM hits JOIN papers ON id = doc_id GROUP BY query_id""",
}
