"""Registered queries on sources, sinks and incremental loads. Files are rendered by Spark from
the driver's tables into the shared folder and read back by the source under test."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlode.functions.resources import resource_map
from paperlode.operators import aggregates, ids, joins
from paperlode.operators.filters import fully_free
from paperlode.plans.align import build_corpus
from paperlode.plans.registered.tables import source_shapes
from paperlode.plans.registered.vectors import HASHED_SQL
from paperlode.plans.registered.views import PAPERS_SQL, as_papers, papers, table, texts
from paperlode.session import scratch_path
from paperlode.sources import bibtex, html, records, sinks, tables
from paperlode.streaming import ingest as stream

_PLAIN = r"[{}\"@\\<>&]"


def _plain(text: str | Column) -> Column:
    """Text without the characters that mean something in BibTeX or HTML."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _PLAIN, ""), r"\s+", " "))


_PLAIN_SQL = r"""trim(regexp_replace(regexp_replace(TEXT, '[{}"@\\<>&]', '', 'g'), '\s+', ' ', 'g'))"""


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_title(table(spark, sf_dir, "pages"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_links(table(spark, sf_dir, "pages"))


def source_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and as a table, read back and compared."""
    docs = table(spark, sf_dir, "documents")
    root = scratch_path(spark, "tree")
    sinks.write_jsonl(docs, f"{root}/a/lines")
    sinks.write_table(docs, f"{root}-table")
    lines = tables.read_jsonl_tree(spark, root, docs.schema)
    stored = tables.read_table(spark, f"{root}-table")
    same = ["doc_id", "text", "lang", "source", "n_chars"]
    return lines.join(stored, same).select("doc_id", "lang", "source", F.length("text").alias("length"))


def append_and_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents stored first, all documents appended, the result snapshotted."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "papers")
    sinks.append_new(joins.known_rows(docs, table(spark, sf_dir, "labels"), "doc_id"), path, "doc_id")
    sinks.append_new(docs, path, "doc_id")
    sinks.append_new(docs, path, "doc_id")
    taken = sinks.write_snapshot(spark.read.parquet(path), path + "-snapshots", datetime(2024, 5, 6, 7, 8, 9))
    return tables.read_jsonl(spark, taken, docs.schema).select("doc_id", "source", "n_chars")


def stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lengths")
    build = lambda: table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    sinks.load_or_build(spark, path, build)
    return sinks.load_or_build(spark, path, build)


def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers rendered as BibTeX, every third with an indented entry, and parsed again."""
    view = papers(spark, sf_dir)
    entry = F.concat(
        F.when(F.col("id") % 3 == 0, "  @").otherwise("@"), F.lit("inproceedings{p-"), F.col("id").cast("string"),
        F.lit(",\n  title = \"On {"), _plain("title"), F.lit("}\",\n  abstract = {"), _plain("abstract"),
        F.lit("},\n  year = "), F.coalesce(F.col("year").cast("string"), F.lit('""')), F.lit("\n}"),
    )
    path = scratch_path(spark, "bib")
    view.select(entry.alias("value")).write.text(path)
    found = bibtex.entry_columns(bibtex.read_bibtex(spark, path), ["title", "abstract", "year"])
    return found.select("ID", "ENTRYTYPE", "title", "year", F.sha2("abstract", 256).alias("abstract_hash"))


def _pages(spark: SparkSession, sf_dir: str, open_tag: Column, year: bool) -> DataFrame:
    view = papers(spark, sf_dir)
    title = _plain("title")
    body = F.concat(
        F.lit("<html><head><title>list</title></head><ul>"), open_tag,
        F.lit('<cite><span itemprop="author"><span itemprop="name">'), F.col("venue"), F.lit(" &amp; Co</span></span>: "),
        F.lit('<span class="title"> '), title, F.lit(" </span>"),
        F.lit('<span itemprop="isPartOf"><span itemprop="name">') if year else F.lit(""),
        F.concat(F.col("venue"), F.lit("</span></span>")) if year else F.lit(""),
        F.lit('<span itemprop="datePublished">2019</span>') if year else F.lit(""),
        F.lit('</cite></li></ul><span itemprop="name">footer</span></html>'),
    )
    url = F.concat(F.lit("https://dblp.org/db/conf/"), F.col("venue"), F.lit("/x2019.html"))
    return view.select(F.col("id").alias("page_id"), url.alias("url"), body.alias("html"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("id") % 2 == 0, F.concat(F.lit(' id="conf/x/'), F.col("id").cast("string"), F.lit('"'))).otherwise("")
    tag = F.concat(F.lit('<li class="entry inproceedings"'), mark, F.lit(">"))
    return html.extract_listing(_pages(spark, sf_dir, tag, False))


def author_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.lit('<li class="entry" itemscope itemtype="http://schema.org/ScholarlyArticle">')
    return html.extract_author_page(_pages(spark, sf_dir, tag, True))


def main_tex_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best main file per venue, taking every document as a LaTeX file."""
    marks = F.concat(F.lit("\\begin{document}"), F.repeat(F.lit("\\section \\cite "), (F.col("id") % 7).cast("int")))
    whole = F.col("abstract").contains("tion")  # the others are parts without a preamble
    files = papers(spark, sf_dir).select(
        F.col("venue").alias("paper_id"), F.format_string("f%08d.tex", "id").alias("path"),
        F.when(whole, F.concat(marks, "abstract")).otherwise(F.col("abstract")).alias("text"),
    )
    return aggregates.main_tex(files)


def free_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rendered as node records, parsed, and narrowed to those wholly free."""
    key = F.col("c_custkey")
    record = F.concat(
        F.lit("NodeName=n"), key.cast("string"), F.lit(" Arch=x86\n   CfgTRES=cpu="), (1 + key % 4).cast("string"),
        F.lit(",mem=2G,billing=3"), F.when(key % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("\n   AllocTRES=cpu="), (key % 3).cast("string"), F.lit(",mem="), (key % 9 * 512).cast("string"), F.lit("M"))
        ), F.lit("\n"),
    )
    path = scratch_path(spark, "nodes")
    table(spark, sf_dir, "customer").select(record.alias("value")).write.text(path)
    fields = records.read_kv_records(spark, path)
    nodes = fields.select(
        F.try_element_at("fields", F.lit("NodeName")).alias("node"),
        resource_map(F.try_element_at("fields", F.lit("CfgTRES"))).alias("cfg"),
        resource_map(F.try_element_at("fields", F.lit("AllocTRES"))).alias("alloc"),
    )
    return fully_free(nodes, "cfg", "alloc").select("node")


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both source shapes as one stored corpus with ids and vectors."""
    path = scratch_path(spark, "corpus")
    build_corpus(source_shapes(as_papers(texts(spark, sf_dir)))).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.filter(F.length("uuid") == 36).select(
        "title", F.coalesce("year", F.lit(0)).alias("year"), "acl", F.coalesce("categories", F.lit("NONE")).alias("categories"),
        F.length("document").alias("length"), F.size("embedding").alias("dims"),
    )


def ir_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, queries and judgements stored as a collection, read back, and the judgements
    moved to the joint integer ids."""
    root = scratch_path(spark, "collection")
    text_id = F.col("doc_id").cast("string").alias("doc_id")
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    sinks.write_jsonl(docs.select(text_id, "text"), f"{root}/documents")
    sinks.write_jsonl(items.select(F.col("item_id").cast("string").alias("query_id"), "text"), f"{root}/queries")
    judged = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 40).cast("string").alias("query_id"), text_id, F.col("quality").alias("relevance")
    )
    sinks.write_jsonl(judged, f"{root}/qrels")
    read = tables.read_ir_collection(spark, root)
    numbers = ids.joint_ids(read.queries, "query_id", read.documents, "doc_id")
    return joins.map_ids(read.qrels, numbers, {"query_id": "query", "doc_id": "doc"})


def ingest_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents arrive twice, then all documents; two runs of the same stream."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labelled = joins.known_rows(docs, table(spark, sf_dir, "labels"), "doc_id")
    root = scratch_path(spark, "ingest")
    target, state = f"{root}/table", f"{root}/state"

    def run() -> None:
        prepare = lambda df: df.select("doc_id", F.upper("source").alias("venue"), F.length("text").alias("length"))
        stream.ingest(spark, f"{root}/in", target, "doc_id", docs.schema, state, prepare).awaitTermination()

    sinks.write_jsonl(labelled, f"{root}/in", "append")
    sinks.write_jsonl(labelled, f"{root}/in", "append")
    run()
    sinks.write_jsonl(docs, f"{root}/in", "append")
    run()
    return spark.read.parquet(target)


def ingest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", "text")
    root = scratch_path(spark, "ingest-vectors")
    sinks.write_table(docs, f"{root}/in")
    stream.ingest_embeddings(
        spark, f"{root}/in", f"{root}/table", "doc_id", "text", docs.schema, f"{root}/state"
    ).awaitTermination()
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + F.round(x.cast("double"), 6))
    return spark.read.parquet(f"{root}/table").select("doc_id", F.round(total, 6).alias("total"))


QUERIES = {
    "page_titles": page_titles,
    "page_links": page_links,
    "source_roundtrip": source_roundtrip,
    "append_and_replace": append_and_replace,
    "stored_once": stored_once,
    "bibtex_entries": bibtex_entries,
    "listing_pages": listing_pages,
    "author_pages": author_pages,
    "main_tex_file": main_tex_file,
    "free_nodes": free_nodes,
    "corpus_build": corpus_build,
    "ir_collection": ir_collection,
    "ingest_available_now": ingest_available_now,
    "ingest_embeddings": ingest_embeddings,
}


def _plain_sql(column: str) -> str:
    return _PLAIN_SQL.replace("TEXT", column)


_NUMBERS = """
WITH sides AS (SELECT 'query' AS side, item_id::VARCHAR AS key FROM benchmark
  UNION ALL SELECT 'doc', doc_id::VARCHAR FROM documents),
numbers AS (SELECT side, key, row_number() OVER (ORDER BY side DESC, substr(md5(key), 1, 3), key) - 1 AS int_id FROM sides)"""

ORACLES = {
    "page_titles": r"""
SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS title
FROM pages""",
    "page_links": """
WITH found AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS links FROM pages)
SELECT page_id, unnest(range(len(links)))::INTEGER AS position, unnest(links) AS href FROM found""",
    "source_roundtrip": "SELECT doc_id, lang, source, length(text)::INTEGER AS length FROM documents",
    "append_and_replace": "SELECT doc_id, source, n_chars FROM documents",
    "stored_once": "SELECT doc_id, n_chars FROM documents",
    "bibtex_entries": f"""
WITH {PAPERS_SQL}
SELECT 'p-' || id AS ID, 'inproceedings' AS ENTRYTYPE, 'On {{' || {_plain_sql("title")} || '}}' AS title,
  coalesce(year::VARCHAR, '') AS year, sha256({_plain_sql("abstract")}) AS abstract_hash FROM papers""",
    "listing_pages": f"""
WITH {PAPERS_SQL}
SELECT 2019 AS year, upper(venue) AS venue, {_plain_sql("title")} AS title,
  CASE WHEN id % 2 = 0 THEN 'conf/x/' || id ELSE sha256({_plain_sql("title")}) END AS dblp_id,
  venue || ' & Co' AS authors FROM papers""",
    "author_pages": f"""
WITH {PAPERS_SQL}
SELECT {_plain_sql("title")} AS title, venue || ' & Co, ' || venue AS author, venue, '2019' AS year FROM papers""",
    "main_tex_file": rf"""
WITH {PAPERS_SQL}, files AS (SELECT venue AS paper_id, printf('f%08d.tex', id) AS path,
  '\begin{{document}}' || repeat('\section \cite ', id % 7) || abstract AS text FROM papers WHERE contains(abstract, 'tion'))
SELECT paper_id, arg_max(path, (len(regexp_extract_all(text, '\\(?:section|begin|cite)')), path)) AS path
FROM files GROUP BY paper_id""",
    "free_nodes": """
WITH nodes AS (
  SELECT 'n' || c_custkey AS node, 1 + c_custkey % 4 AS cpu, 2048 AS mem,
    CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 3 END AS used_cpu,
    CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 9 * 512 END AS used_mem FROM customer)
SELECT node FROM nodes WHERE used_cpu < cpu AND used_mem < mem""",
    "corpus_build": f"""
WITH {PAPERS_SQL}
SELECT '[' || id || '] ' || title AS title, coalesce(year(try_strptime(update_date, '%Y-%m-%d')), 1900)::INTEGER AS year,
  0 AS acl, categories, (length('[' || id || '] ' || title) + 1 + length(abstract))::INTEGER AS length, 64 AS dims FROM papers
UNION ALL SELECT title, coalesce(year, 0), 1, 'NONE', (length(title) + 1 + length(abstract))::INTEGER, 64 FROM papers""",
    "ir_collection": _NUMBERS + """
SELECT q.int_id AS query_id, d.int_id AS doc_id, quality AS relevance FROM labels l
JOIN numbers q ON q.side = 'query' AND q.key = (l.doc_id % 40)::VARCHAR
JOIN numbers d ON d.side = 'doc' AND d.key = l.doc_id::VARCHAR""",
    "ingest_available_now": """
SELECT doc_id, upper(source) AS venue, length(text)::INTEGER AS length FROM documents""",
    "ingest_embeddings": f"""
WITH {HASHED_SQL} SELECT doc_id, round(sum(round(x, 6)), 6) AS total FROM hashed GROUP BY doc_id""",
}
