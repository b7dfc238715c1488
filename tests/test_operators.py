import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from paperlode.functions.text import STOP_WORDS
from paperlode.operators import ann, bm25, columns, embedding, evaluate, filters, ids, joins, knn, ranking, report, sets
from paperlode.plans.align import align
from paperlode.streaming import ingest as stream

HYP = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_align_metadata(spark):
    df = spark.createDataFrame(
        [
            ("2001.00001", "A", "cs.SE cs.LG", "2020-01-01"),
            ("2001.00002", "B", "math.CO", "2020-13-01"),
            ("2001.00003", "C", "cs.SE, cs.CR", None),
        ],
        "id STRING, title STRING, categories STRING, update_date STRING",
    ).withColumns({"abstract": F.lit("x"), "authors": F.lit("y")})
    got = {r["title"]: r for r in align(df, "arxiv").collect()}
    a, b, c = got["[2001.00001] A"], got["[2001.00002] B"], got["[2001.00003] C"]
    assert (a["year"], a["cs_se"], a["cs_lg"], a["cs_cr"], a["acl"]) == (2020, 1, 1, 0, 0)
    assert (b["year"], b["cs_se"]) == (1900, 0)
    assert (c["year"], c["cs_se"], c["cs_cr"]) == (1900, 1, 1)
    assert a["url"] == "https://www.arxiv.org/abs/2001.00001"


def test_filter_spec(spark):
    df = spark.createDataFrame([(2021, 1, 0), (2022, 0, 1), (2023, 0, 0), (2024, 1, 1)], "year INT, acl INT, `cs.LG` INT")
    spec = {
        "$and": [{"year": {"$lt": 2024}}, {"year": {"$gte": 2022}}],
        "$or": [{"acl": {"$eq": 1}}, {"cs.LG": {"$eq": 1}}],
    }
    assert [r["year"] for r in df.filter(filters.build_filter(spec)).collect()] == [2022]
    assert df.filter(filters.build_filter({})).count() == 4
    assert df.filter(filters.build_filter({"year": {"$in": [2021, 2023]}, "acl": {"$ne": 1}})).count() == 1
    with pytest.raises(ValueError):
        filters.build_filter({"year": {"$near": 1}})


def test_defaults(spark):
    df = spark.createDataFrame([(2000, "a"), (None, "a"), (2010, "b")], "year INT, venue STRING")
    assert filters.apply_defaults(df).count() == 2
    assert filters.apply_defaults(df, ["a"], 1999, None).count() == 1


def test_column_tools(spark):
    df = spark.createDataFrame([("t", None, 1, [1])], "title STRING, note STRING, n INT, xs ARRAY<INT>")
    assert columns.fill_none(df).first()["note"] == "NONE"
    assert columns.ensure_text_cols(df, ["abstract", "title"]).first()["abstract"] == ""
    assert columns.scalar_columns_only(df).columns == ["title", "note", "n"]


@HYP
@given(st.sets(st.text("abcdef", min_size=1, max_size=4), min_size=1, max_size=40), st.integers(0, 39))
def test_dense_ids_continue_and_are_stable(spark, keys, cut):
    keys = sorted(keys)
    known = spark.createDataFrame([(k,) for k in keys[:cut]], "k STRING")
    everything = spark.createDataFrame([(k,) for k in keys + keys[:3]], "k STRING")
    first = ids.dense_ids(known, "k")
    full = ids.dense_ids(everything, "k", first)
    rows = {r["k"]: r["int_id"] for r in full.collect()}
    assert sorted(rows.values()) == list(range(len(keys)))
    for r in first.collect():
        assert rows[r["k"]] == r["int_id"] < cut
    assert {r["k"]: r["int_id"] for r in ids.dense_ids(everything, "k", full).collect()} == rows


def test_new_and_known_rows_partition_the_input(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(40)], "k INT, v INT")
    known = spark.createDataFrame([(0,), (3,), (3,), (99,)], "k INT")
    new, old = joins.new_rows(df, known, "k"), joins.known_rows(df, known, "k")
    assert sorted(map(tuple, new.union(old).collect())) == sorted(map(tuple, df.collect()))
    assert {r["k"] for r in old.collect()} == {0, 3}


def test_dedupe_first_with_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    got = {r["k"]: r["id"] for r in sets.dedupe_first(df, "k", "id").collect()}
    assert len(got) == 2001 and got[0] == 0


def test_ranking(spark):
    df = spark.createDataFrame([(1, 5, 0.5, 2001), (1, 4, 0.5, 2003), (1, 6, 0.9, 2002), (1, 7, 0.1, 2009)], "query_id LONG, doc_id LONG, score DOUBLE, year INT")
    top = ranking.top_k_per(df, k=3).orderBy("rank")
    assert [r["doc_id"] for r in top.collect()] == [6, 4, 5]
    kept = ranking.rerank(top.filter("doc_id <> 4")).orderBy("rank")
    assert [(r["rank"], r["doc_id"]) for r in kept.collect()] == [(0, 6), (1, 5)]
    shown = ranking.top_n_display(df, 3, tie="doc_id")
    assert [r["year"] for r in shown.collect()] == [2003, 2002, 2001]


def brute_bm25(texts, query):
    import regex

    def words(t):
        return [w for w in regex.findall(r"[\p{L}\p{N}_]{2,}", t.lower()) if w not in STOP_WORDS]

    docs = {i: Counter(words(t)) for i, t in texts.items()}
    avg = sum(sum(c.values()) for c in docs.values()) / len(docs)
    found = {}
    for i, c in docs.items():
        score = 0.0
        for w in words(query):
            df = sum(w in d for d in docs.values())
            if c[w]:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                score += idf * c[w] / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg))
        found[i] = round(score, 6)
    return found


def test_bm25_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["model", "models", "graph", "the", "deep", "survey", "über", "x1"]
    texts = {i: " ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for i in range(60)}
    texts[60] = texts[0]
    query = "deep deep the Graph survey missing"
    want = brute_bm25(texts, query)
    df = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    assert {r["doc_id"]: r["score"] for r in bm25.score_docs(df, "text", query).collect()} == want
    index = bm25.bm25_index(df, "doc_id", "text")
    assert {r["doc_id"]: r["score"] for r in bm25.bm25_rank_all(index, query).collect()} == want
    best = sorted((i for i in want if want[i] > 0), key=lambda i: (-want[i], i))[:10]
    for hits in (bm25.bm25_search(index, query, 10), bm25.bm25_topk(df, "doc_id", "text", query, 10)):
        assert [r["doc_id"] for r in hits.collect()] == best
    assert bm25.bm25_search(index, "nothing here", 5).count() == 0
    assert bm25.bm25_topk(df, "doc_id", "text", "the", 5).count() == 0
    batch = bm25.bm25_batch(index, spark.createDataFrame([(7, query), (8, "zzz")], "query_id LONG, text STRING"), 10)
    assert [r["doc_id"] for r in batch.orderBy("rank").collect()] == best


def test_normaliser_by_vocabulary_equals_in_row(spark):
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def no_s(terms: pd.Series) -> pd.Series:
        return terms.str.replace("s$", "", regex=True)

    df = spark.createDataFrame([(1, "models model graphs"), (2, "graph news"), (3, "none")], "id LONG, text STRING")
    rows = {}
    for fn in (no_s, lambda t: F.regexp_replace(t, "s$", "")):
        index = bm25.bm25_index(df, "id", "text", fn)
        rows[fn] = sorted(map(tuple, index.postings.select("term", "doc_id", "tf", "doc_len").collect()))
    assert len(set(map(tuple, rows.values()))) == 1
    assert ("model", 1, 2, 3) in next(iter(rows.values()))


def _vectors(spark, n=80, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    data = np.round(rng.normal(size=(n, dim)), 2)
    data[n // 2 :] = data[0]  # one vector makes up half of the table
    data[5] = 0.0
    rows = [(int(i), [float(x) for x in v], int(i % 4)) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT").repartition(3)


def _brute(data, queries, k, metric):
    found = []
    for q, v in enumerate(queries):
        if metric == "l2":
            s = -((data - v) ** 2).sum(axis=1)
        else:
            s = data @ v
        if metric == "cosine":
            norm = np.linalg.norm(data, axis=1) * np.linalg.norm(v)
            s = np.divide(s, norm, out=np.zeros_like(s), where=norm > 0)
        s = np.round(s, 6) + 0.0
        order = sorted(range(len(data)), key=lambda i: (-s[i], i))[:k]
        found += [(q, i, float(s[i]), r + 1) for r, i in enumerate(order)]
    return sorted(found)


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("block", [4096, 2])
def test_knn_equals_brute_force(spark, monkeypatch, metric, block):
    data, docs = _vectors(spark)
    monkeypatch.setattr(knn, "BLOCK_BYTES", block * 6 * 8)
    rows = [(i, [float(x) for x in data[i] + 0.1]) for i in range(5)]
    queries = spark.createDataFrame(rows, "query_id LONG, query_vec ARRAY<DOUBLE>")
    hits = knn.knn(docs, queries, metric, 60)
    got = sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in hits.collect())
    assert got == _brute(data, [np.array(v) for _, v in rows], 60, metric)


def test_best_hits_survive_compaction():
    rng = np.random.default_rng(0)
    scores = np.round(rng.integers(0, 9, size=(5000, 3)).astype(float), 6)
    best = knn.BestHits(3, 4)
    best.room = 50
    for at in range(0, 5000, 100):
        best.add(scores[at : at + 100], np.arange(at, at + 100), np.arange(3))
    best.shrink()
    for q in range(3):
        want = sorted(range(5000), key=lambda i: (-scores[i, q], i))[:4]
        mine = best.query == q
        assert [int(d) for d in best.doc[mine]] == want


def test_cells_with_all_probes_equal_exact_search(spark):
    data, docs = _vectors(spark)
    queries = spark.createDataFrame([(0, [0.3] * 6), (1, [float(x) for x in data[2]])], "query_id LONG, query_vec ARRAY<DOUBLE>")
    centroids = ann.ivf_train(docs, 4)
    assigned = ann.ivf_assign(docs, centroids)
    exact = sorted(map(tuple, knn.knn(docs, queries, "l2", 30).collect()))
    assert sorted(map(tuple, ann.ivf_knn(assigned, queries, centroids, 4, 30).collect())) == exact
    narrow = ann.ivf_knn(assigned, queries, centroids, 1, 30).collect()
    assert narrow and {(r["query_id"], r["doc_id"]) for r in narrow}


def test_product_codes_that_lose_nothing_equal_exact_search(spark):
    rows = [(i, [float(i % 3), float(i // 3)]) for i in range(9)]
    docs = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(0, [0.2, 1.1]), (1, [2.0, 2.0])], "query_id LONG, query_vec ARRAY<DOUBLE>")
    book = spark.createDataFrame([(s, c, [float(c)]) for s in range(2) for c in range(3)], ann.CODEBOOK)
    exact = sorted(map(tuple, knn.knn(docs, queries, "l2", 5).collect()))
    assert sorted(map(tuple, ann.pq_knn(ann.pq_encode(docs, book), queries, book, 5).collect())) == exact
    centroids = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 2.0])], ann.CENTROIDS)
    gaps = ann.residuals(ann.ivf_assign(docs, centroids), centroids)
    wide = spark.createDataFrame([(s, c, [float(c - 2)]) for s in range(2) for c in range(5)], ann.CODEBOOK)
    coded = ann.pq_encode(gaps, wide)
    assert sorted(map(tuple, ann.pq_knn(coded, queries, wide, 5, centroids, 2).collect())) == exact
    trained = ann.pq_train(docs, 2, 9, 3)
    assert trained.count() == 18


def test_postfilter_is_a_subset_and_may_be_short(spark):
    _, docs = _vectors(spark)
    queries = spark.createDataFrame([(0, [0.3] * 6)], "query_id LONG, query_vec ARRAY<DOUBLE>")
    papers = docs.select("vec_id", "label")
    where = {"label": {"$eq": 1}}
    wide = {r["doc_id"] for r in knn.knn(docs, queries, "l2", 25).collect()}
    kept = {r["vec_id"] for r in knn.knn_postfilter(docs, papers, queries, where, 5).collect()}
    assert kept <= wide and len(kept) <= 5
    before = knn.knn(docs, queries, "l2", 5, where).collect()
    assert len(before) == 5 and all(r["doc_id"] % 4 == 1 for r in before)


@pytest.mark.parametrize("block", [4096, 3])
def test_pair_queries_takes_any_number(spark, monkeypatch, block):
    data, docs = _vectors(spark)
    monkeypatch.setattr(knn, "BLOCK_BYTES", block * 6 * 8)
    queries = docs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    assert knn.pair_queries(docs, queries.limit(3)).count() == 240
    pairs = knn.pair_queries(docs.select("vec_id", "label"), queries).collect()
    assert {(r["vec_id"], r["query_id"]) for r in pairs} == {(a, b) for a in range(80) for b in range(80)}
    assert len(pairs) == 6400 and all(r["query_vec"] == data[r["query_id"]].tolist() for r in pairs[::50])


def test_queries_stream_in_blocks_and_hits_merge_in_parts(spark, monkeypatch):
    data, docs = _vectors(spark)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 100)
    queries = docs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    sent = knn.send(queries)
    assert sent.n_queries == 80 and len(sent.blocks) == 27
    assert max(b.value.rows.nbytes for b in sent.blocks) <= 144
    hits = knn.knn(docs.repartition(40), queries, "l2", 3)
    got = sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in hits.collect())
    assert got == _brute(data, list(data), 3, "l2")


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_nearest_cells_are_exact_for_any_number_of_centroids(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK_BYTES", block)
    monkeypatch.setattr(ann, "GROUP_ROWS", 7)
    rng = np.random.default_rng(4)
    centers = np.round(rng.normal(size=(90, 3)), 1)
    centers[50] = centers[3]  # equally near ones
    rows = [(i, [float(x) for x in c], i // 9) for i, c in enumerate(centers)]
    for frame in (
        spark.createDataFrame(rows, "cell INT, centroid ARRAY<DOUBLE>, parent INT"),
        spark.createDataFrame([r[:2] for r in rows], "cell INT, centroid ARRAY<DOUBLE>"),
    ):
        vectors = np.round(rng.normal(size=(200, 3)), 2)
        far = np.round(((vectors[:, None] - centers[None]) ** 2).sum(axis=2), 6)
        want = [sorted(range(90), key=lambda c: (f[c], c)) for f in far]
        sent = ann.send_centroids(frame)
        assert (ann.nearest_cells(vectors, sent, 1)[:, 0] == [w[0] for w in want]).all()
        assert (ann.nearest_cells(vectors, sent, 5) == [w[:5] for w in want]).all()
        assert ann.nearest_cells(vectors, sent, 500).shape == (200, 90)
        assert (len(sent) > 1) == (block == 200)


def test_two_level_cells(spark):
    data, docs = _vectors(spark)
    centroids = ann.ivf_train_two_level(docs, 9)
    cells = [r["cell"] for r in centroids.collect()]
    assert len(cells) == len(set(cells)) <= 9 and {r["parent"] for r in centroids.collect()} == {c // 3 for c in cells}
    assigned = ann.ivf_assign(docs, centroids)
    assert {r["cell"] for r in assigned.collect()} <= set(cells) and assigned.count() == 80


def test_residual_codes_need_no_row_per_cell(spark, monkeypatch):
    """4,096 queries that each look into 200 cells: one row per query is sent, not one per pair."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(200, 4))
    frame = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], ann.CENTROIDS)
    docs = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(4096)], "query_id LONG, query_vec ARRAY<DOUBLE>")
    gaps = ann.residuals(ann.ivf_assign(docs, frame), frame)
    book = ann.pq_train(gaps, 2, 16, 3)
    sent = knn.send(ann.probed(queries, frame, 200))
    assert sum(b.value.rows.nbytes for b in sent.blocks) == 4096 * 4 * 8
    coded = ann.pq_encode(gaps, book)
    hits = ann.pq_knn(coded, queries, book, 2, frame, 200)
    assert hits.count() == 2 * 4096
    codes = {r["vec_id"]: (r["cell"], r["codes"]) for r in coded.collect()}
    books = ann._book(book)
    near = {i: centers[c] + np.concatenate([books[s][x] for s, x in enumerate(own)]) for i, (c, own) in codes.items()}
    vectors = {r["query_id"]: np.array(r["query_vec"]) for r in queries.filter("query_id < 20").collect()}
    for r in hits.filter("query_id < 20").collect():
        assert abs(r["score"] + ((vectors[r["query_id"]] - near[r["doc_id"]]) ** 2).sum()) < 1e-5


def test_bm25_reads_fewer_postings_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 10)
    monkeypatch.setattr(bm25, "FIRST_BLOCKS", 3)
    monkeypatch.setattr(bm25, "ASKERS", 2)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    often = [1 / (i + 1) for i in range(300)]  # few frequent words and many rare ones, as in any language
    texts = {i: " ".join(rng.choices(vocabulary, often, k=int(2 ** rng.uniform(0, 9)))) for i in range(600)}
    texts.update({600 + i: "w1 w2 w3" for i in range(200)})  # one text is a quarter of all
    questions = {q: f"w{q} w{q + 1} w{200 + q}" for q in range(6)} | {6: "nothing", 7: "w1 w1 w2"}
    df = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    queries = spark.createDataFrame(list(questions.items()), "query_id LONG, text STRING")
    index = bm25.bm25_index(df, "doc_id", "text")
    got = {}
    for r in bm25.bm25_batch(index, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for q, text in questions.items():
        want = brute_bm25(texts, text)
        best = sorted((i for i in want if want[i] > 0), key=lambda i: (-want[i], i))[:5]
        assert [(i, want[i]) for i in best] == got.get(q, [])
    weights = bm25._weights(index, queries, None)
    bounds = bm25.block_bounds(index, weights)
    first = ranking.top_k_per(bounds, "query_id", "most", 3, tie="block").drop("rank")
    best = ranking.top_k_per(bm25._scores(index, weights, first, F.lit(1)), "query_id", "score", 5)
    read = first.unionByName(bm25.still_possible(bounds, first, best, 5)).join(weights, "query_id")
    read = read.join(index.blocks, ["term", "block"]).agg(F.sum("n")).first()[0]
    every = index.blocks.join(weights, "term").agg(F.sum("n")).first()[0]
    assert read < 0.6 * every


def test_bm25_among_narrows_hits_not_statistics(spark):
    texts = {i: "graph model " + "x1 " * (i % 7) for i in range(50)}
    df = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    index = bm25.bm25_index(df, "doc_id", "text")
    among = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "doc_id LONG")
    want = brute_bm25(texts, "graph x1")
    best = sorted(range(0, 50, 3), key=lambda i: (-want[i], i))[:4]
    got = [(r["doc_id"], r["score"]) for r in bm25.bm25_search(index, "graph x1", 4, among=among).collect()]
    assert got == [(i, want[i]) for i in best]


def test_metrics_fixture(spark):
    run = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (2, 4, 0.9), (2, 5, 0.8)], "query_id LONG, doc_id LONG, score DOUBLE")
    qrels = spark.createDataFrame([(1, 2, 1), (2, 5, 1), (2, 9, 1), (3, 7, 1)], "query_id LONG, doc_id LONG, relevance INT")
    got = {r["query_id"]: (r["RR"], round(r["nDCG@5"], 6), r["R@5"]) for r in evaluate.per_query(qrels, run).collect()}
    assert got == {1: (0.5, 0.63093, 1.0), 2: (0.5, 0.386853, 0.5), 3: (0.0, 0.0, 0.0)}
    means = {r["metric"]: r["value"] for r in evaluate.evaluate(qrels, run).collect()}
    assert list(means) == evaluate.METRIC_NAMES and round(means["RR"], 6) == 0.333333
    both = evaluate.compare_variants(qrels, {("Flat", 0): run, ("IVFFlat", 8): run.filter("query_id = 1")}).collect()
    assert [(r["index_type"], round(r["R@5"], 6)) for r in both] == [("Flat", 0.5), ("IVFFlat", 0.333333)]
    timed = evaluate.timed_variants(qrels, {("Flat", 0): lambda: run}).first()
    assert timed["seconds"] > 0 and round(timed["R@5"], 6) == 0.5


def test_small_helpers(spark):
    from paperlode.operators.aggregates import concat_text

    hits = spark.createDataFrame([(1, 5), (1, -1)], "query_id LONG, doc_id LONG")
    assert [r["doc_id"] for r in filters.valid_hits(hits).collect()] == [5]
    titles = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z")], "g STRING, t STRING")
    assert {r["g"]: r["t"] for r in concat_text(titles, "g", "t").collect()} == {"a": "x y", "b": "z"}
    assert [r["t"] for r in ranking.limit_rows(titles, 2, "t").collect()] == ["x", "y"]
    both = sets.union_all(titles, titles.drop("t"))
    assert both.count() == 6 and both.filter("t IS NULL").count() == 3


def test_reports_are_written_as_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb")], "query_id LONG, report STRING")
    report.write_reports(df, str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b"]


def test_report_text(spark):
    rows = [(1, 1, "b", "2021-02-02", "U", "y", "Q"), (1, 0, "a", "2020-01-01", "T", "x", "P")]
    df = spark.createDataFrame(rows, "query_id LONG, rank INT, arxiv_id STRING, update_date STRING, title STRING, abstract STRING, authors STRING")
    assert report.markdown_report(df).first()["report"] == (
        "**[1. [a] T](https://arxiv.org/pdf/a.pdf)** (2020-01-01)\n\n*P*\n\nx\n\n---\n\n"
        "**[2. [b] U](https://arxiv.org/pdf/b.pdf)** (2021-02-02)\n\n*Q*\n\ny\n\n---\n"
    )


def test_feedback_leaves_unmarked_positions_out(spark):
    hits = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 12)], "query_id LONG, position INT, doc_id LONG")
    marks = spark.createDataFrame([(1, 0, "relevant"), (1, 2, "irrelevant")], "query_id LONG, position INT, label STRING")
    good, bad = joins.split_feedback(hits, marks)
    assert [r["doc_id"] for r in good.collect()] == [10] and [r["doc_id"] for r in bad.collect()] == [12]


def test_embedding_with_a_batch_function(spark, tmp_path):
    def make():
        def fn(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return fn

    df = spark.createDataFrame([(1, "aa"), (2, None), (3, "bbbb")], "id LONG, text STRING")
    got = {r["id"]: r["embedding"] for r in embedding.embed(df, "text", make, batch_size=2).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0], 3: [4.0, 1.0]}
    path = str(tmp_path / "v")
    embedding.index_update(df.filter("id < 3"), path, "id", "text", make_fn=make)
    embedding.index_update(df, path, "id", "text", make_fn=make)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_hashed_vectors_are_unit_length(spark):
    df = spark.createDataFrame([("deep graph graph",), ("",)], "t STRING")
    a, b = [r[0] for r in df.select(embedding.hashed_vector(F.col("t"), 16)).collect()]
    assert len(a) == len(b) == 16 and abs(sum(x * x for x in a) - 1) < 1e-6 and not any(b)


def test_stream_twice_equals_once(spark, tmp_path):
    src, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "id STRING, v STRING")

    def run():
        stream.ingest(spark, src, table, "id", df.schema, state, order="v").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(table).collect()))

    df.write.json(src)
    assert run() == run() == [("a", "x"), ("b", "z")]
    spark.createDataFrame([("b", "q"), ("c", "r")], "id STRING, v STRING").write.mode("append").json(src)
    assert run() == [("a", "x"), ("b", "z"), ("c", "r")]


def test_uneven_and_broken_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [0.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id LONG, query_vec ARRAY<DOUBLE>")
    for metric in knn.METRICS:
        assert sorted(r["doc_id"] for r in knn.knn(docs, queries, metric, 5).collect()) == [1, 5]
    odd = docs.union(spark.createDataFrame([(6, [1.0])], docs.schema)).coalesce(1)
    with pytest.raises(Exception, match="id 6 has 1 components"):
        knn.knn(odd, queries, "ip", 5).collect()


def test_any_cutoff_and_unknown_ids(spark):
    from paperlode.operators import evaluate, joins

    qrels = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "query_id LONG, doc_id LONG, relevance INT")
    run = spark.createDataFrame([(1, 1, 0.9), (1, 3, 0.8), (1, 2, 0.7)], "query_id LONG, doc_id LONG, score DOUBLE")
    assert evaluate.recall(qrels, run, 2).first()[1] == 0.5 and evaluate.recall(qrels, run, 3).first()[1] == 1.0
    ids = spark.createDataFrame([("doc", "a", 7)], "side STRING, key STRING, int_id INT")
    found = joins.map_ids(spark.createDataFrame([("a",), ("b",)], "doc_id STRING"), ids, {"doc_id": "doc"})
    assert sorted(map(tuple, found.collect()), key=str) == [(7,), (None,)]
