"""Exact nearest-neighbour search.

The corpus stays where it is and is read once. Queries are sent to the tasks in blocks of bounded
size; a task takes a bounded chunk of its vectors, opens one block after the other, scores the
chunk against the block with a matrix product and passes on only the k best per query. Neither
the driver nor a task holds more than one block at a time, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from paperlode.memory import handing_back
from paperlode.operators.filters import build_filter
from paperlode.operators.ranking import merged_top_k, top_k_per

# Bytes of the query vectors that are sent as one block, and of the vectors of one chunk.
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 64 << 20
# Most cells of one score matrix; several copies of it, and of the hits in it, are held at a time.
MATRIX_CELLS = 1_000_000
# About how many pairs of a document and a query are made at once.
PAIR_ROWS = 10_000
# Most hits broadcast to a later join: 32 MB.
BROADCAST_HITS = 1_000_000
DIGITS = 6
HITS = "query_id BIGINT, doc_id BIGINT, score DOUBLE"

# Scores a chunk: (vectors or codes, query rows, cell of the vectors) -> matrix, higher is better.
Scorer = Callable[[np.ndarray, np.ndarray, int | None], np.ndarray]


class Block(NamedTuple):
    """Queries that are sent together; ``probes``: cell to the positions of those that look into
    it, or None if all look at every vector."""

    ids: np.ndarray
    rows: np.ndarray
    probes: dict[int, np.ndarray] | None = None


class Sent(NamedTuple):
    """The queries, as the tasks get them."""

    blocks: list[Broadcast]
    n_queries: int
    cells: set[int]


def blocks_of(queries: DataFrame) -> Iterator[Block]:
    """The queries (``query_id``, ``query_vec``[, ``cells``]) in blocks of ``BLOCK_BYTES``; they
    stream through the driver."""
    ids: list[int] = []
    rows: list[list[float]] = []
    cells: list[list[int]] = []

    def block() -> Block:
        rows_ = np.array(rows, dtype=np.float64)
        return Block(np.array(ids, dtype=np.int64), rows_, _by_cell(cells) if cells else None)

    size = 0
    for r in queries.toLocalIterator():
        ids.append(r["query_id"])
        rows.append(r["query_vec"])
        if "cells" in r:
            cells.append(r["cells"])
        size += 8 * len(rows[-1])
        if size >= BLOCK_BYTES:
            yield block()
            ids, rows, cells, size = [], [], [], 0
    if ids:
        yield block()


def _by_cell(cells: list[list[int]]) -> dict[int, np.ndarray]:
    """Cell to positions of the queries that look into it."""
    query = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    flat = np.array([c for own in cells for c in own], dtype=np.int64)
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
    parts = np.split(query[order], starts[1:])
    return {int(flat[order[at]]): part for at, part in zip(starts, parts, strict=True)}


def send(queries: DataFrame) -> Sent:
    """Broadcasts the queries block by block."""
    context = queries.sparkSession.sparkContext
    blocks: list[Broadcast] = []
    n_queries, cells = 0, set()
    for block in blocks_of(queries):
        cells.update(block.probes or ())
        n_queries += len(block.ids)
        blocks.append(context.broadcast(block))
    return Sent(blocks, n_queries, cells)


def opened(blocks: list[Broadcast]) -> Iterator:
    """What was sent, one block after the other; of several, each leaves the memory of the task
    before the next."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)


def matrix(column: pa.Array, ids: pa.Array | None = None) -> np.ndarray:
    """A list column without nulls as a matrix of doubles. Vectors of unequal length are an
    error that names the id, if ids are given."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(sizes != sizes[:1])
    if len(odd):
        at = int(odd[0])
        name = "" if ids is None else f" of id {ids[at].as_py()}"
        raise ValueError(f"vector{name} has {sizes[at]} components, others have {sizes[0]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _ip(docs: np.ndarray, queries: np.ndarray, cell: int | None = None) -> np.ndarray:
    return docs @ queries.T


def _cosine(docs: np.ndarray, queries: np.ndarray, cell: int | None = None) -> np.ndarray:
    return unit_rows(docs) @ unit_rows(queries).T


def _l2(docs: np.ndarray, queries: np.ndarray, cell: int | None = None) -> np.ndarray:
    squares = (docs * docs).sum(axis=1)[:, None] + (queries * queries).sum(axis=1)[None, :]
    return -np.maximum(squares - 2.0 * (docs @ queries.T), 0.0)


METRICS: dict[str, Scorer] = {"ip": _ip, "cosine": _cosine, "l2": _l2}


class BestHits:
    """The k best (query, doc, score) triples per query seen so far: highest score first, then
    lowest doc id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.doc = np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)
        self.floor = np.full(n_queries, -np.inf)
        self.room = 2 * n_queries * k + 200_000

    def add(self, scores: np.ndarray, docs: np.ndarray, queries: np.ndarray) -> None:
        """``scores``: docs x queries; ``queries``: positions of the columns in the block."""
        scores = np.round(scores, DIGITS) + 0.0
        row, col = np.nonzero(scores >= self.floor[queries][None, :])
        self.query = np.concatenate([self.query, queries[col]])
        self.doc = np.concatenate([self.doc, docs[row]])
        self.score = np.concatenate([self.score, scores[row, col]])
        if len(self.query) > self.room:
            self.shrink()

    def shrink(self) -> None:
        order = np.lexsort((self.doc, -self.score, self.query))
        query = self.query[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        last = order[place == self.k - 1]
        self.floor[self.query[last]] = self.score[last]
        kept = order[place < self.k]
        self.query, self.doc, self.score = self.query[kept], self.doc[kept], self.score[kept]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(ids, vectors, cells) of about ``CHUNK_BYTES``; vectors with a NaN are left out."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = matrix(batch.column(1), batch.column(0))
        whole = ~np.isnan(vectors).any(axis=1)
        columns = [batch.column(0).to_numpy(zero_copy_only=False), vectors]
        if batch.num_columns > 2:
            columns.append(batch.column(2).to_numpy(zero_copy_only=False))
        held.append(tuple(c[whole] for c in columns))
        size += vectors.nbytes
        if size >= CHUNK_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    if len({h[1].shape[1] for h in held if len(h[1])}) > 1:
        raise ValueError("vectors have unequal numbers of components")
    columns = [np.concatenate(c) for c in zip(*[h for h in held if len(h[0])] or held[:1], strict=True)]
    return columns[0], columns[1], columns[2] if len(columns) > 2 else None


def best_hits_task(
    sent: Sent, score: Scorer, k: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function each task runs over batches of (id, vector[, cell]). With cells, a vector is
    scored against the queries that look into its cell only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, vectors, cells in _chunks(batches):
            for block in opened(sent.blocks):
                best = BestHits(len(block.ids), k)
                for cell, queries in (block.probes or {None: np.arange(len(block.ids))}).items():
                    inside = slice(None) if cell is None else np.flatnonzero(cells == cell)
                    ids, rows = docs[inside], vectors[inside]
                    step = max(1, MATRIX_CELLS // max(1, len(queries)))
                    for at in range(0, len(ids), step):
                        part = slice(at, at + step)
                        best.add(score(rows[part], block.rows[queries], cell), ids[part], queries)
                best.shrink()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[best.query]), pa.array(best.doc), pa.array(best.score)],
                    names=["query_id", "doc_id", "score"],
                )

    return run


def best_hits(rows: DataFrame, sent: Sent, score: Scorer, k: int) -> DataFrame:
    """The k best per query, with ranks, of ``rows`` (id, vector[, cell]). At most
    ``n_queries * k`` rows can come out; when that is a small number they are marked for broadcast,
    so that looking up the hit papers does not shuffle the papers."""
    best = merged_top_k(rows.mapInArrow(handing_back(best_hits_task(sent, score, k)), HITS), k)
    return F.broadcast(best) if sent.n_queries * k <= BROADCAST_HITS else best


def knn(
    docs: DataFrame,
    queries: DataFrame,
    metric: str = "ip",
    k: int = 10,
    where: Mapping[str, object] | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """The k nearest documents per query: ``query_id``, ``doc_id``, ``score``, ``rank``.

    ``queries`` holds ``query_id BIGINT`` and ``query_vec``. ``metric`` is ``ip``, ``cosine``
    or ``l2`` (score = minus the squared distance). ``where`` narrows the documents before
    ranking and is pushed to the scan. A vector that is null or has a null or NaN component is
    near to nothing and never a hit, in any metric.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if where:
        docs = docs.filter(build_filter(where))
    vectors = docs.select(id_col, vec_col).filter(F.col(vec_col).isNotNull())

    asked = queries.select("query_id", "query_vec")
    return best_hits(vectors, send(asked), METRICS[metric], k)


def cosine_search(docs: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    return knn(docs, queries, "cosine", k, **options)


def pair_queries(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every document next to every query vector of a stated set, for scores that are all wanted.
    Queries come to the documents block by block; pairs leave a task as they are made, and
    nothing is shuffled."""
    sent = send(queries.select("query_id", "query_vec"))
    names = docs.columns
    own = [StructField("query_id", LongType()), StructField("query_vec", ArrayType(DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in opened(sent.blocks):
                vectors = pa.array(list(block.rows), pa.list_(pa.float64()))
                step = max(1, PAIR_ROWS // len(block.ids))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    row = np.repeat(np.arange(part.num_rows), len(block.ids))
                    query = np.tile(np.arange(len(block.ids)), part.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.take(pa.array(row)) for c in part.columns], pa.array(block.ids[query]), vectors.take(pa.array(query))],
                        names=[*names, "query_id", "query_vec"],
                    )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *own]))


def knn_postfilter(
    docs: DataFrame,
    papers: DataFrame,
    queries: DataFrame,
    where: Mapping[str, object],
    n: int,
    factor: int = 5,
    metric: str = "l2",
    key: str = "vec_id",
    **options,
) -> DataFrame:
    """kNN for ``factor * n`` hits, the filter after it, then the n best that are left (perhaps
    fewer than n)."""
    hits = knn(docs, queries, metric, factor * n, id_col=key, **options).drop("rank")
    kept = papers.filter(build_filter(where)).join(hits, papers[key] == hits["doc_id"]).drop("doc_id")
    return top_k_per(kept, "query_id", "score", n, tie=key)
