"""Nearest neighbours with the shipped settings against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperlode.llm import queries, vectors


def exact(ids, data, asked, k=20):
    rows = []
    score = data @ data[asked].T
    for j, q in enumerate(asked):
        order = np.lexsort((ids, -score[:, j]))
        order = order[ids[order] != ids[q]][:k]
        rows += [(ids[q], r + 1, ids[i], score[i, j]) for r, i in enumerate(order)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])


def test_query_reaches_its_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, data = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), dtype=np.float64)
    want = exact(ids, data, np.nonzero(ids % 20 == 0)[0])
    got = queries.QUERIES["op7_dimension_scan"](spark, "/root/testdata/sf0.1").toPandas()
    assert got.groupby("query_id").size().eq(20).all() and len(got) == len(want)
    assert vectors.recall(got, want) >= 0.9
    each = got.merge(want, on=["query_id", "vec_id"])
    assert (abs(each["score_x"] - each["score_y"]) < 1e-9).all()
    assert got.sort_values(["query_id", "rank"])["score"].groupby(got["query_id"]).apply(lambda s: s.is_monotonic_decreasing).all()


@pytest.mark.parametrize("piece", [4_096, 16])
def test_repeated_rows_and_long_lists(spark, monkeypatch, piece):
    """A third of all rows are one vector, one query stands twice, one id has two vectors."""
    monkeypatch.setattr(vectors, "PIECE", piece)
    rng = np.random.default_rng(5)
    data = np.round(rng.normal(size=(300, 8)), 3)
    data[200:] = data[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [rows[20], rows[20], (40, [float(x) for x in data[41]]), (900, None), (901, [1.0]), (902, [0.0] * 8)]
    extra = [(*r, "x", 1, 2) for r in rows]
    table = spark.createDataFrame(extra, "vec_id long, embedding array<double>, cell string, bundle int, asks int").repartition(6)
    with pytest.warns(UserWarning, match="1 vectors"):
        got = vectors.search(table, F.col("vec_id") % 20 == 0, 5, probed=1.0).toPandas()
    ids = np.array([r[0] for r in rows if r[1] and len(r[1]) == 8 and any(r[1])])
    every = np.array([r[1] for r in rows if r[1] and len(r[1]) == 8 and any(r[1])])
    asked = {}
    for i, q in enumerate(ids):
        if q % 20 == 0 and (q not in asked or every[i].tolist() < every[asked[q]].tolist()):
            asked[q] = i
    want = exact(ids, every, list(asked.values()), 5)
    key = ["query_id", "rank"]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert got[["query_id", "rank", "vec_id"]].astype(int).equals(want[["query_id", "rank", "vec_id"]].astype(int))
    assert (abs(got["score"] - want["score"]) < 1e-9).all()


def test_lists_are_bundled():
    bundle, pieces = vectors.bundled(np.array([3000, 1000, 200, 9000, 0, 5000, 10]))
    assert bundle.tolist() == [0, 0, 1, 2, 3, 3, 4] and pieces.tolist() == [1, 1, 1, 3, 1, 2, 1]
