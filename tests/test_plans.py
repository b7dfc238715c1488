"""The plans Spark makes of the operators."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from paperlode.operators import ann, bm25, knn
from paperlode.operators.ranking import top_k_per
from paperlode.plans.registered import QUERIES
from paperlode.plans.registered.views import as_papers
from paperlode.session import scratch_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefilter_reaches_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = docs.limit(2).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    text = plan(knn.knn(docs, queries, "l2", 5, {"label": {"$eq": 3}}))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(label,3\)", text)
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in text


def test_ranks_are_cut_before_the_shuffle(spark):
    hits = spark.range(100).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("doc_id"), F.rand(1).alias("score"))
    text = plan(top_k_per(hits, k=3))
    assert len(re.findall("WindowGroupLimit", text)) == 2


def test_index_search_prunes_postings(spark, sf_dir):
    path = scratch_path(spark, "bm25")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bm25.write_index(bm25.bm25_index(docs, "doc_id", "text"), path)
    text = plan(bm25.bm25_search(bm25.read_index(spark, path), "tion sted", 5))
    assert re.search(r"postings\].*PushedFilters: \[[^\]]*In\(term, \[", text)


def test_batch_scores_are_added_up_where_the_document_is(spark, sf_dir):
    text = plan(QUERIES["bm25_batch"](spark, sf_dir))
    assert not re.search(r"hashpartitioning\(query_id#\d+L, doc_id#", text)
    assert re.search(r"hashpartitioning\(block#\d+L, part#\d+L, 8\)", text)


def test_cell_search_prunes_folders(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    centroids = ann.ivf_train(docs, 4, max_iter=2)
    path = scratch_path(spark, "cells")
    ann.write_cells(ann.ivf_assign(docs, centroids), path)
    queries = docs.limit(1).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    text = plan(ann.ivf_knn(spark.read.parquet(path), queries, centroids, 1, 5))
    assert re.search(r"PartitionFilters: \[[^\]]*cell", text)


def test_index_search_of_papers_reads_no_text(spark, sf_dir):
    from paperlode.plans.search import search_index

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "papers")
    as_papers(docs).write.parquet(path)
    view = spark.read.parquet(path)
    bm25.write_index(bm25.bm25_index(view, "id", "abstract"), path + "-index")
    found = search_index(bm25.read_index(spark, path + "-index"), view, "tion sted", 5).select("id", "year", "score")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(found))
    assert schemas and not any("abstract" in s or "title" in s for s in schemas)
    assert found.count() == 5


def test_hits_are_cut_twice(spark, sf_dir):
    text = plan(QUERIES["knn_l2"](spark, sf_dir))
    assert re.search(r"hashpartitioning\(query_id#\d+L, _part#\d+, \d+\)", text)
    assert len(re.findall(r"hashpartitioning\(query_id#\d+L, \d+\)", text)) == 1
    assert len(re.findall("WindowGroupLimit", text)) == 4


NO_SHUFFLE = ["category_flags", "category_like", "year_closed", "filter_spec", "page_links", "hash_id", "query_text"]


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_row_wise_queries_do_not_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["bm25_topk", "knn_ip", "dense_ids", "metric_summary", "bm25_batch", "search_report"])
def test_no_cross_products(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_code_has_no_local_checkpoint_or_cross_join():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/paperlode/**/*.py", recursive=True):
        code = open(path).read()
        assert "localCheckpoint" not in code and "crossJoin" not in code, path
