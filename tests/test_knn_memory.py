"""Memory of the task that searches vectors, whatever the numbers of vectors and queries."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from paperlode.operators import knn


class Sent:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("n_queries", [200, 2_000])
def test_scores_of_a_chunk_are_made_in_small_parts(n_queries):
    rng = np.random.default_rng(1)
    queries, docs = rng.standard_normal((n_queries, 16)), rng.standard_normal((20_000, 16))
    flat = pa.ListArray.from_arrays(np.arange(0, docs.size + 1, 16, dtype=np.int32), pa.array(docs.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(docs))), flat], names=["id", "v"])
    sent = knn.Sent([Sent(knn.Block(np.arange(n_queries), queries))], n_queries, set())
    tracemalloc.start()
    try:
        (found,) = knn.best_hits_task(sent, knn.METRICS["ip"], 5)(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150 << 20  # bytes; above 290 MB with matrices of four million cells
    best = {}
    for q, d in zip(*(c.to_numpy() for c in found.columns[:2]), strict=True):
        best.setdefault(int(q), set()).add(int(d))
    for q in range(0, n_queries, 97):
        score = np.round(docs @ queries[q], 6)
        assert best[q] == set(np.lexsort((np.arange(len(docs)), -score))[:5].tolist())
