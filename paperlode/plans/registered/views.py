"""The driver's tables and the views the registered queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlode.functions.text import STOP_WORDS, TERM_PATTERN, paper_url
from paperlode.operators.aggregates import mean_pool
from paperlode.sources.tables import read_table, spread

# Categories dealt out to the papers view, by document id.
CATEGORIES = ["cs.CL", "cs.SE", "cs.CR", "cs.LG", "cs.AI", "cs.IR", "math.CO", "stat.ML"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for work that is heavy per row."""
    return spread(table(spark, sf_dir, "documents"))


def as_papers(documents: DataFrame) -> DataFrame:
    """Documents seen as papers: the first line is the title, the whole text the abstract, and
    the bibliographic fields follow from the id, with gaps and broken dates."""
    doc = F.col("doc_id")
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    first = F.get(cats, (doc % 8).cast("int"))
    second = F.get(cats, (F.floor(doc / 8) % 8).cast("int"))
    sep = F.when(doc % 2 == 0, " ").otherwise(", ")
    year = (2000 + doc % 25).cast("int")
    return documents.select(
        doc.alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.col("source").alias("venue"),
        F.when(doc % 17 != 0, year).alias("year"),
        F.when(doc % 3 == 0, first).otherwise(F.concat(first, sep, second)).alias("categories"),
        F.format_string(
            "%04d-%02d-%02d",
            year,
            F.when(doc % 13 == 0, 13).otherwise((1 + doc % 12).cast("int")),
            (1 + doc % 28).cast("int"),
        ).alias("update_date"),
        paper_url(doc.cast("string"), "www").alias("url"),
        F.array(
            F.array(F.col("source"), F.col("lang"), F.lit("")),
            F.array(F.concat(F.lit("Roe"), (doc % 97).cast("string")), F.lit("Al"), F.lit("Jr")),
        ).alias("authors_parsed"),
        F.concat(F.col("lang"), F.lit(" "), F.col("source"), F.lit(", Al Roe")).alias("authors"),
        "n_chars",
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_papers(table(spark, sf_dir, "documents"))


_CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"

PAPERS_SQL = f"""
papers AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS abstract, source AS venue,
    CASE WHEN doc_id % 17 <> 0 THEN (2000 + doc_id % 25)::INTEGER END AS year,
    CASE WHEN doc_id % 3 = 0 THEN {_CATEGORY_LIST}[1 + doc_id % 8]
      ELSE {_CATEGORY_LIST}[1 + doc_id % 8] || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE ', ' END
        || {_CATEGORY_LIST}[1 + (doc_id // 8) % 8] END AS categories,
    printf('%04d-%02d-%02d', 2000 + doc_id % 25,
      CASE WHEN doc_id % 13 = 0 THEN 13 ELSE 1 + doc_id % 12 END, 1 + doc_id % 28) AS update_date,
    'https://www.arxiv.org/abs/' || doc_id AS url,
    lang || ' ' || source || ', Jr Al Roe' || doc_id % 97 AS author_string,
    lang || ' ' || source || ', Al Roe' AS authors,
    n_chars
  FROM documents)"""


def label_queries(vectors: DataFrame) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    tokens = vectors.filter(F.col("label").isNotNull()).select("label", "embedding", F.lit(1).alias("mask"))
    pooled = mean_pool(tokens, "label")
    return pooled.select(
        F.col("label").cast("bigint").alias("query_id"), F.col("embedding").alias("query_vec")
    )


QUERY_CELLS_SQL = """
cells AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos
  FROM embeddings),
means AS (SELECT label::BIGINT AS query_id, pos, avg(x) AS x FROM cells GROUP BY ALL),
queries AS (SELECT query_id, list(x ORDER BY pos) AS query_vec FROM means GROUP BY query_id),
docs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(source: str, key: str, text: str, name: str, term: str = "term") -> str:
    """A select of (``name``, term) rows, stop words left out."""
    found = (
        f"SELECT {key} AS {name}, "
        f"unnest(regexp_extract_all(lower({text}), '{TERM_PATTERN}')) AS term FROM {source}"
    )
    return f"SELECT {name}, {term} AS term FROM ({found}) WHERE term NOT IN ({STOP_SQL})"


def bm25_sql(source: str, key: str, text: str, queries: str, term: str = "term") -> str:
    """Common table expressions that end in ``scores`` (query_id, doc_id, score)."""
    return f"""
tok AS ({tokens_sql(source, key, text, "doc_id", term)}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT d.{key} AS doc_id, coalesce(sum(tf), 0)::BIGINT AS doc_len
        FROM {source} d LEFT JOIN tf ON tf.doc_id = d.{key} GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(doc_len) AS a FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qtok AS ({tokens_sql(f"({queries})", "query_id", "text", "query_id", term)}),
q AS (SELECT query_id, term, count(*) AS repeats FROM qtok GROUP BY ALL),
scores AS (
  SELECT query_id, doc_id, round(sum(
      repeats * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
      * (tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / a)))), 6) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len USING (doc_id), tot
  GROUP BY ALL)"""


def knn_sql(metric: str, k: int, docs: str = "docs", queries: str = "queries") -> str:
    """A select of (query_id, doc_id, score, rank)."""
    score = {
        "ip": "list_dot_product(v, query_vec)",
        "cosine": "list_cosine_similarity(v, query_vec)",
        "l2": "-pow(list_distance(v, query_vec), 2)",
    }[metric]
    return f"""
SELECT query_id, vec_id AS doc_id, score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT query_id, vec_id, round({score}, 6) + 0.0::DOUBLE AS score FROM {docs}, {queries}))
WHERE rank <= {k}"""
