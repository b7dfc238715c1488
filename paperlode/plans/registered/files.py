"""Registered queries on stored files and tables: listings, LaTeX trees, catalog tables, loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlode.operators import aggregates, crawl
from paperlode.operators.filters import valid_hits
from paperlode.operators.knn import knn
from paperlode.operators.ranking import limit_rows
from paperlode.plans.registered.tables import _FRONTIER, _frontier
from paperlode.plans.registered.vectors import vectors
from paperlode.plans.registered.views import PAPERS_SQL, QUERY_CELLS_SQL, as_papers, knn_sql, label_queries, papers, table, texts
from paperlode.session import scratch_path
from paperlode.sources import records, sinks
from paperlode.streaming import ingest as stream


def frontier_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles stored by venue and year; what is due follows from the sizes of the files."""
    root = scratch_path(spark, "listings")
    view = papers(spark, sf_dir).filter(F.col("year").isNotNull()).select("venue", "year", "title")
    view.repartition("venue", "year").write.partitionBy("venue", "year").text(root)
    listing = crawl.stored_listings(spark, root, "*.txt")
    return crawl.due_pages(_frontier(spark, sf_dir), listing, 1).select("venue", "year", "url")


def tex_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts stored as the LaTeX files of their venues and years, read back as a tree; for each
    paper how many files it has, and whether one of them is a main file."""
    root = scratch_path(spark, "latex")
    whole = (F.col("year") % 3 != 0) & F.col("abstract").contains("e")
    body = F.regexp_replace("abstract", r"[\r\n]+", " ")
    text = F.when(whole, F.concat(F.lit("\\begin{document} \\section "), body)).otherwise(body)
    name = F.concat_ws("-", "venue", F.coalesce("year", F.lit(0)))
    as_papers(texts(spark, sf_dir)).select(name.alias("paper_id"), text.alias("text")).repartition(
        "paper_id"
    ).write.partitionBy("paper_id").text(root)
    files = records.read_tex_files(spark, root, "*.txt")
    main = aggregates.main_tex(files).select("paper_id", F.lit(True).alias("has_main"))
    lacking = aggregates.papers_without_main_tex(files).select("paper_id", F.lit(False).alias("has_main"))
    lengths = files.groupBy("paper_id").agg(F.sum(F.length("text")).alias("length"))
    return main.unionByName(lacking).join(lengths, "paper_id")


def table_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog table of all documents, replaced by the labelled ones."""
    name = f"paperlode_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    path = scratch_path(spark, "catalog")
    spark.sql(f"CREATE TABLE {name} (doc_id BIGINT, source STRING, n_chars BIGINT) USING parquet LOCATION '{path}'")
    sinks.replace_table(docs, name)
    sinks.replace_table(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"), name)
    return spark.table(name)


def hits_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a search that marks what it could not find by -1."""
    docs = vectors(spark, sf_dir)
    hits = knn(docs, label_queries(docs), "l2", 30)
    padded = hits.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("doc_id")))
    return valid_hits(padded).select("query_id", "doc_id", "rank")


def load_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a load wrote, counted while it was written."""
    docs, seen = aggregates.load_counts(table(spark, sf_dir, "documents").select("doc_id"), "load")
    sinks.write_table(docs, scratch_path(spark, "load"))
    return spark.createDataFrame([(seen.get["rows"],)], "rows BIGINT")


def newest_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_rows(papers(spark, sf_dir).select("id", "update_date", "venue"), 25, "venue", "update_date", "id")


def ingest_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed target fed with differing rows of one key: of each batch the row with the least
    version is kept, and of later batches only new keys."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    root = scratch_path(spark, "ingest-versions")
    target, state = f"{root}/table", f"{root}/state"
    versions = docs.withColumn("version", F.explode(F.array(*[F.lit(v) for v in (3, 1, 2)])))

    def run() -> None:
        stream.ingest(
            spark, f"{root}/in", target, "doc_id", versions.schema, state, order="version", digits=1
        ).awaitTermination()

    sinks.write_jsonl(versions.filter("doc_id % 3 = 0"), f"{root}/in", "append")
    run()
    later = versions.withColumn("version", F.col("version") - 5)
    sinks.write_jsonl(later, f"{root}/in", "append")
    run()
    run()
    return sinks.read_bucketed(spark, target)


QUERIES = {
    "frontier_stored": frontier_stored,
    "tex_tree": tex_tree,
    "table_replaced": table_replaced,
    "hits_found": hits_found,
    "load_rows": load_rows,
    "newest_limit": newest_limit,
    "ingest_duplicates": ingest_duplicates,
}

ORACLES = {
    "frontier_stored": f"""
WITH {PAPERS_SQL}, {_FRONTIER},
stored AS (SELECT venue, year, sum(octet_length(encode(title)) + 1) AS length FROM papers WHERE year IS NOT NULL GROUP BY ALL)
SELECT venue, year, url FROM frontier LEFT JOIN stored USING (venue, year)
WHERE length IS NULL OR length / 1024 <= 1""",
    "tex_tree": rf"""
WITH {PAPERS_SQL}, bodies AS (
  SELECT venue || '-' || coalesce(year, 0) AS paper_id, coalesce(year % 3 <> 0 AND contains(abstract, 'e'), false) AS main,
    length(regexp_replace(abstract, '[\r\n]+', ' ', 'g')) AS n FROM papers)
SELECT paper_id, bool_or(main) AS has_main,
  sum(n + 1 + CASE WHEN main THEN length('\begin{{document}} \section ') ELSE 0 END)::BIGINT AS length
FROM bodies GROUP BY paper_id""",
    "table_replaced": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "hits_found": f"""
WITH {QUERY_CELLS_SQL}, hits AS ({knn_sql("l2", 30)})
SELECT query_id, doc_id, rank FROM hits WHERE doc_id % 5 <> 0""",
    "load_rows": "SELECT count(*) AS rows FROM documents",
    "newest_limit": f"""
WITH {PAPERS_SQL} SELECT id, update_date, venue FROM papers ORDER BY venue, update_date, id LIMIT 25""",
    "ingest_duplicates": """
SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE -4 END AS version FROM documents""",
}
