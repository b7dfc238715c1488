"""Every registered query against its SQL oracle, or a property where SQL cannot say it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from paperlode.operators import ann, knn
from paperlode.plans.registered import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(frame):
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, clean.values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf_dir, oracle, name):
    got = _rows(QUERIES[name](spark, sf_dir).toPandas())
    want = _rows(oracle.execute(ORACLES[name]).fetchdf())
    assert got == want


def _doc_sets(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["query_id"], set()).add(r["doc_id"])
    return found


@pytest.mark.parametrize("name", ["ivf_kmeans", "pq_knn", "ivf_pq"])
def test_approximate_queries_fill_their_ranks(spark, sf_dir, name):
    ranks = {}
    for r in QUERIES[name](spark, sf_dir).collect():
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    assert len(ranks) == 10 and all(sorted(v) == list(range(1, 21)) for v in ranks.values())


def test_approximate_search_finds_most_neighbours(spark, sf_dir):
    """Recall@10 with stored vectors as queries."""
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = docs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = _doc_sets(knn.knn(docs, queries, "l2", 10))
    centroids = ann.ivf_train(docs, 16)
    cells = ann.ivf_assign(docs, centroids)
    book = ann.pq_train(docs, 32, 64, 5)
    gaps = ann.residuals(cells, centroids)
    gap_book = ann.pq_train(gaps, 32, 64, 5)
    runs = {
        "ivf": ann.ivf_knn(cells, queries, centroids, 4, 10),
        "pq": ann.pq_knn(ann.pq_encode(docs, book), queries, book, 10),
        "ivf_pq": ann.pq_knn(ann.pq_encode(gaps, gap_book), queries, gap_book, 10, centroids, 4),
    }
    recall = {}
    for name, run in runs.items():
        found = _doc_sets(run)
        recall[name] = sum(len(exact[q] & found[q]) for q in exact) / (10 * len(exact))
    print(recall)
    assert recall["ivf"] > 0.6 and recall["pq"] > 0.6 and recall["ivf_pq"] > 0.5


def test_random_ids_are_unique(spark, sf_dir):
    ids = [r["uuid"] for r in QUERIES["random_rows"](spark, sf_dir).collect()]
    assert len(set(ids)) == len(ids) and all(len(i) == 36 for i in ids)


def test_every_query_without_oracle_is_tested_here():
    assert set(QUERIES) - set(ORACLES) == {"ivf_kmeans", "pq_knn", "ivf_pq", "random_rows"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "score"]
