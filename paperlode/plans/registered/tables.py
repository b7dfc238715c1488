"""Registered queries on papers, ids, dates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlode.functions import text as tx
from paperlode.operators import columns, crawl, filters, ids, joins, ranking, sets
from paperlode.operators.aggregates import distinct_values, missing_count, value_range
from paperlode.plans.align import align
from paperlode.plans.registered.views import PAPERS_SQL, papers, table
from paperlode.schemas import FLAG_CATEGORIES, FLAG_COLUMNS
from paperlode.sources.tables import run_sql

AS_OF = "1998-08-02"
_SPEC = {
    "$and": [{"year": {"$lt": 2020}}, {"year": {"$gte": 2004}}],
    "$or": [{"acl": {"$eq": 1}}, {"cs_lg": {"$eq": 1}}, {"venue": {"$in": ["src1", "src2"]}}],
    "n_chars": {"$gt": 100},
}
_FLAGS_SQL = ", ".join(
    f"list_contains(regexp_split_to_array(trim(categories), '[,\\s]+'), '{c}')::INTEGER AS {n}"
    for c, n in zip(FLAG_CATEGORIES, FLAG_COLUMNS)
)


def source_shapes(view: DataFrame) -> dict[str, DataFrame]:
    """The papers view in the shape of both bibliographic sources."""
    return {
        "arxiv": view.select(
            F.col("id").cast("string").alias("id"), "title", "abstract", "authors", "update_date", "categories"
        ),
        "acl": view.select(
            "title", "abstract", F.col("authors").alias("author"), "url", F.col("year").cast("string").alias("year"),
            F.col("venue").alias("booktitle"),
        ),
    }


def align_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sets.union_all(*[align(df, name) for name, df in source_shapes(papers(spark, sf_dir)).items()])
    return both.select(
        "title", "authors", "url", F.coalesce("year", F.lit(0)).alias("year"), "acl", *FLAG_COLUMNS, F.length("abstract").alias("length")
    )


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as strings, some broken, some missing."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    broken = F.concat(F.substring(day, 1, 4), F.lit("-13-01"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(key % 7 == 0, broken).when(key % 11 != 0, day).alias("day")
    )


_ORDERS = """
dated AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y') || '-13-01'
  WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)"""


def year_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated_orders(spark, sf_dir).select("o_orderkey", tx.year_or_default(F.col("day")).alias("year"))


def recent_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = filters.recent_only(_dated_orders(spark, sf_dir), "day", AS_OF)
    return recent.select("o_orderkey", tx.iso_date(F.try_to_date("day", "yyyy-MM-dd")).alias("day"))


def category_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = columns.category_flags(papers(spark, sf_dir))
    fixed = F.array(*[F.lit(c) for c in FLAG_CATEGORIES])
    common = tx.shared(tx.category_tokens(F.col("categories")), fixed)
    return flagged.select("id", *FLAG_COLUMNS, F.size(common).alias("n_shared"))


def category_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.category_prefix(papers(spark, sf_dir), "cs.").select("id", "categories")


def category_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = filters.date_from(papers(spark, sf_dir), "update_date", "2010-01-01")
    return filters.category_like(dated, "cs.SE").select("id", "categories", "update_date")


def latest_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.category_like(papers(spark, sf_dir), "cs.LG").select("id", "update_date")
    return found.orderBy(F.desc("update_date"), "id").limit(10)


def year_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.year_closed(papers(spark, sf_dir), 2005, 2010).select("id", "year")


def year_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.year_half_open(papers(spark, sf_dir), 2005, 2010).select("id", "year")


def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.in_list(papers(spark, sf_dir), "year", [2023, 2024])
    return filters.in_list(found, "venue", ["src1", "src4", "src9"]).select("id", "year", "venue")


def min_count_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year")
    ).agg(F.count("*").alias("n"))
    return ranking.sort_desc(filters.min_count(counts, "n", 2, 1993, 1997), "n", "custkey")


def filter_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = columns.add_constants(columns.category_flags(papers(spark, sf_dir)), {"acl": 0})
    kept = view.filter(filters.build_filter(_SPEC))
    return filters.doc_contains(kept, "tion", "abstract").select("id", "year", "venue", "cs_lg")


def default_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_defaults(papers(spark, sf_dir)).select("id", "venue", "year")


def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_range(papers(spark, sf_dir), "year")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(papers(spark, sf_dir), "venue")


def authors_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    parsed = F.array(
        F.array("c_name", "c_mktsegment", F.lit("")), F.array(last, F.lit("X"), F.lit("Jr"))
    )
    loose = F.array(F.concat(F.lit("  "), "c_name"), F.concat("c_mktsegment", F.lit(" ")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.author_string(parsed).alias("authors"), tx.join_names(loose).alias("names")
    )


def hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("id") % 2 == 0, F.col("id").cast("string"))
    return papers(spark, sf_dir).select("id", tx.paper_id(given, F.col("title")).alias("paper_id"))


def hashed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.with_uuid(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.with_uuid(table(spark, sf_dir, "documents").select("doc_id"))


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    venue = F.col("venue")
    pattern = F.concat(F.lit("https://dblp.org/db/conf/"), venue, F.lit("/"), venue, F.lit("{year}.html"))
    patterns = distinct_values(papers(spark, sf_dir), "venue").withColumn("pattern", pattern)
    return crawl.frontier(patterns)


def url_year_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _frontier(spark, sf_dir).select("url").unionByName(table(spark, sf_dir, "pages").select("url"))
    return pages.select(
        "url", F.coalesce(tx.url_year(F.col("url")), F.lit(0)).alias("url_year"), tx.url_venue(F.col("url")).alias("url_venue")
    )


def frontier_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = papers(spark, sf_dir).groupBy("venue", "year").agg(F.sum("n_chars").alias("length"))
    return crawl.due_pages(_frontier(spark, sf_dir), stored).select("venue", "year", "url")


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Keyed by a hash, so that the texts themselves are not shuffled.
    first = sets.dedupe_first(docs, F.sha2("text", 256), "doc_id")
    return first.select("doc_id", "lang", "source", "n_chars")


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.new_rows(docs, table(spark, sf_dir, "labels"), "doc_id")


def known_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.known_rows(docs, table(spark, sf_dir, "labels"), "doc_id")


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_count(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = sets.id_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return ranking.sorted_ids(left, "doc_id")


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents get ids first; the others continue after them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper"))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("paper"))
    id_map = ids.dense_ids(docs, "paper", ids.dense_ids(labelled, "paper"))
    return joins.attach_int_ids(docs, id_map, "paper", "paper")


def joint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.joint_ids(
        table(spark, sf_dir, "benchmark"), "item_id", table(spark, sf_dir, "documents"), "doc_id"
    )


def sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = filters.all_of(
        papers(spark, sf_dir), F.col("year").isNotNull(), F.col("categories").contains("cs.")
    )
    sql = "SELECT id, title, year FROM papers WHERE categories LIKE :like AND year >= :first ORDER BY id"
    return run_sql(spark, sql, {"papers": view}, {"like": "%cs.SE%", "first": 2008})


def scalar_columns_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.all_strings(columns.scalar_columns_only(table(spark, sf_dir, "embeddings")))


def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = tx.query_text(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(
        "item_id", spoken.alias("query"), tx.prefixed_query(spoken).alias("prefixed")
    )


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing text columns added, nulls replaced, columns renamed and dropped."""
    view = papers(spark, sf_dir).select(
        "id", F.when(F.col("id") % 5 != 0, F.col("venue")).alias("venue"),
        F.when(F.col("id") % 3 != 0, F.col("categories")).alias("categories"), "year",
    )
    view = columns.fill_empty(columns.fill_none(columns.ensure_text_cols(view, ["comments"]), ["venue"]), ["categories"])
    return columns.rename_cols(columns.drop_cols(view, ["year"]), {"venue": "journal"})


QUERIES = {
    "align_papers": align_papers,
    "year_or_default": year_or_default,
    "recent_only": recent_only,
    "category_flags": category_flags,
    "category_prefix": category_prefix,
    "category_like": category_like,
    "latest_papers": latest_papers,
    "year_closed": year_closed,
    "year_half_open": year_half_open,
    "in_list": in_list,
    "min_count_sorted": min_count_sorted,
    "filter_spec": filter_spec,
    "default_range": default_range,
    "year_range": year_range,
    "venues": venues,
    "authors_string": authors_string,
    "hash_id": hash_id,
    "hashed_rows": hashed_rows,
    "random_rows": random_rows,
    "url_year_venue": url_year_venue,
    "frontier_due": frontier_due,
    "dedupe_first": dedupe_first,
    "new_rows": new_rows,
    "known_rows": known_rows,
    "missing_count": missing,
    "missing_ids": missing_ids,
    "dense_ids": dense_ids,
    "joint_ids": joint_ids,
    "sql_view": sql_view,
    "scalar_columns_only": scalar_columns_only,
    "query_text": query_text,
    "filled": filled,
}

_P = f"WITH {PAPERS_SQL} "
_KEY = "ORDER BY substr(md5(paper), 1, 3), paper"
_FRONTIER = """
frontier AS (
  SELECT venue, y::INTEGER AS year, 'https://dblp.org/db/conf/' || venue || '/' || venue || y || '.html' AS url
  FROM (SELECT DISTINCT venue FROM papers), (SELECT unnest(range(2000, 2025)) AS y))"""

ORACLES = {
    "align_papers": f"""
WITH {PAPERS_SQL}
SELECT '[' || id || '] ' || title AS title, authors, url,
  coalesce(year(try_strptime(update_date, '%Y-%m-%d')), 1900)::INTEGER AS year, 0 AS acl,
  {_FLAGS_SQL}, length(abstract)::INTEGER AS length FROM papers
UNION ALL
SELECT title, authors, url, coalesce(year, 0), 1, 0, 0, 0, 0, 0, 0, length(abstract)::INTEGER FROM papers""",
    "year_or_default": f"""
WITH {_ORDERS} SELECT o_orderkey, coalesce(year(try_strptime(day, '%Y-%m-%d')), 1900)::INTEGER AS year FROM dated""",
    "recent_only": f"""
WITH {_ORDERS} SELECT o_orderkey, strftime(try_strptime(day, '%Y-%m-%d'), '%Y-%m-%d') AS day FROM dated
WHERE try_strptime(day, '%Y-%m-%d') >= DATE '{AS_OF}' - 1825""",
    "category_flags": _P + f"""
SELECT id, {_FLAGS_SQL}, (SELECT count(DISTINCT c) FROM
    (SELECT unnest(regexp_split_to_array(trim(categories), '[,\\s]+')) AS c)
    WHERE c IN ({", ".join(f"'{c}'" for c in FLAG_CATEGORIES)}))::INTEGER AS n_shared FROM papers""",
    "category_prefix": _P + r"SELECT id, categories FROM papers WHERE regexp_matches(categories, '(^|\s)cs\.')",
    "category_like": _P + """
SELECT id, categories, update_date FROM papers
WHERE categories LIKE '%cs.SE%' AND try_strptime(update_date, '%Y-%m-%d') >= DATE '2010-01-01'""",
    "latest_papers": _P + """
SELECT id, update_date FROM papers WHERE categories LIKE '%cs.LG%' ORDER BY update_date DESC, id LIMIT 10""",
    "year_closed": _P + "SELECT id, year FROM papers WHERE year BETWEEN 2005 AND 2010",
    "year_half_open": _P + "SELECT id, year FROM papers WHERE year >= 2005 AND year < 2010",
    "in_list": _P + """
SELECT id, year, venue FROM papers WHERE year IN (2023, 2024) AND venue IN ('src1', 'src4', 'src9')""",
    "min_count_sorted": """
SELECT o_custkey AS custkey, year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders
WHERE year(o_orderdate) BETWEEN 1993 AND 1997 GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, custkey""",
    "filter_spec": f"""
WITH {PAPERS_SQL}, flagged AS (SELECT *, {_FLAGS_SQL} FROM papers)
SELECT id, year, venue, cs_lg FROM flagged WHERE year < 2020 AND year >= 2004
AND (cs_lg = 1 OR venue IN ('src1', 'src2')) AND n_chars > 100 AND contains(abstract, 'tion')""",
    "default_range": _P + """
SELECT id, venue, year FROM papers WHERE venue IN (SELECT DISTINCT venue FROM papers)
AND year BETWEEN (SELECT min(year) FROM papers) AND (SELECT max(year) FROM papers)""",
    "year_range": _P + "SELECT min(year) AS min_year, max(year) AS max_year FROM papers",
    "venues": _P + "SELECT DISTINCT venue FROM papers",
    "authors_string": """
SELECT c_custkey, trim(' ' || c_mktsegment || ' ' || c_name) || ', Jr X N' || c_nationkey AS authors,
  c_name || ', ' || c_mktsegment AS names FROM customer""",
    "hash_id": _P + """
SELECT id, CASE WHEN id % 2 = 0 THEN id::VARCHAR ELSE sha256(title) END AS paper_id FROM papers""",
    "hashed_rows": "SELECT doc_id, sha256(doc_id::VARCHAR) AS uuid FROM documents",
    "url_year_venue": f"""
WITH {PAPERS_SQL}, {_FRONTIER}, urls AS (SELECT url FROM frontier UNION ALL SELECT url FROM pages)
SELECT url, coalesce(nullif(regexp_extract(url, '\\d{{4}}'), '')::INTEGER, 0) AS url_year,
  coalesce(nullif(upper(regexp_extract(url, 'db/conf/([^/]+)/', 1)), ''), 'UNKNOWN') AS url_venue FROM urls""",
    "frontier_due": f"""
WITH {PAPERS_SQL}, {_FRONTIER},
stored AS (SELECT venue, year, sum(n_chars) AS length FROM papers GROUP BY ALL)
SELECT venue, year, url FROM frontier LEFT JOIN stored USING (venue, year)
WHERE length IS NULL OR length / 1024 <= 5""",
    "dedupe_first": """
SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "new_rows": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "known_rows": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "missing_count": "SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "missing_ids": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels ORDER BY doc_id",
    "dense_ids": f"""
WITH known AS (SELECT paper, row_number() OVER ({_KEY}) - 1 AS int_id
  FROM (SELECT DISTINCT doc_id::VARCHAR AS paper FROM labels)),
fresh AS (SELECT paper, row_number() OVER ({_KEY}) - 1 + (SELECT max(int_id) + 1 FROM known) AS int_id
  FROM (SELECT DISTINCT doc_id::VARCHAR AS paper FROM documents) WHERE paper NOT IN (SELECT paper FROM known)),
id_map AS (SELECT * FROM known UNION ALL SELECT * FROM fresh)
SELECT d.doc_id::VARCHAR AS paper, int_id FROM documents d LEFT JOIN id_map ON paper = d.doc_id::VARCHAR""",
    "joint_ids": """
WITH sides AS (SELECT DISTINCT 'query' AS side, item_id::VARCHAR AS key FROM benchmark
  UNION ALL SELECT DISTINCT 'doc', doc_id::VARCHAR FROM documents)
SELECT side, key, row_number() OVER (ORDER BY side DESC, substr(md5(key), 1, 3), key) - 1 AS int_id FROM sides""",
    "sql_view": _P + """
SELECT id, title, year FROM papers WHERE categories LIKE '%cs.SE%' AND year >= 2008 ORDER BY id""",
    "scalar_columns_only": "SELECT vec_id::VARCHAR AS vec_id, label::VARCHAR AS label FROM embeddings",
    "query_text": """
WITH spoken AS (SELECT item_id, array_to_string(list_transform(string_split(text, ','), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), ' ') AS query
  FROM benchmark)
SELECT item_id, query, 'Represent this sentence for searching relevant passages: ' || query AS prefixed FROM spoken""",
    "filled": _P + """
SELECT id, CASE WHEN id % 5 <> 0 THEN venue ELSE 'NONE' END AS journal,
  CASE WHEN id % 3 <> 0 THEN categories ELSE '' END AS categories, '' AS comments FROM papers""",
}
