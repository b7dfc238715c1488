"""Approximate nearest-neighbour search: coarse cells and product quantisation.

Centroids are a table. Tasks get them in blocks of bounded size, one after the other, and a block
holds them in groups with a middle and a radius: a vector is compared only with groups that
can be near enough, so the cells are exactly the nearest ones, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from paperlode.operators import knn as exact
from paperlode.operators.knn import (
    DIGITS,
    MATRIX_CELLS,
    METRICS,
    best_hits,
    matrix,
    opened,
    send,
)
from paperlode.operators.ranking import top_k_per
from paperlode.session import settle

CENTROIDS = "cell INT, centroid ARRAY<DOUBLE>"
CODEBOOK = "slot INT, code INT, centroid ARRAY<DOUBLE>"
# Most centroids of a group, and vectors per centroid that the second level is trained on.
GROUP_ROWS = 1_024
PER_CENTROID = 64


class Group(NamedTuple):
    cells: np.ndarray
    centers: np.ndarray
    middle: np.ndarray
    radius: float


def send_centroids(centroids: DataFrame) -> list[Broadcast]:
    """The centroids (``cell``, ``centroid``[, ``parent``]) as blocks of groups; they stream
    through the driver."""
    context = centroids.sparkSession.sparkContext
    with_parent = "parent" in centroids.columns
    ordered = centroids.orderBy("parent", "cell") if with_parent else centroids.orderBy("cell")
    sent: list[Broadcast] = []
    groups: list[Group] = []
    rows: list = []
    size = 0

    def close() -> None:
        nonlocal rows
        if rows:
            centers = np.array([r["centroid"] for r in rows], dtype=np.float64)
            middle = centers.mean(axis=0)
            radius = math.sqrt(((centers - middle) ** 2).sum(axis=1).max())
            groups.append(Group(np.array([r["cell"] for r in rows], dtype=np.int64), centers, middle, radius))
        rows = []

    for r in ordered.toLocalIterator():
        if rows and (len(rows) == GROUP_ROWS or (with_parent and r["parent"] != rows[-1]["parent"])):
            close()
            if size >= exact.BLOCK_BYTES:
                sent.append(context.broadcast(groups))
                groups, size = [], 0
        rows.append(r)
        size += 8 * len(r["centroid"])
    close()
    if groups:
        sent.append(context.broadcast(groups))
    return sent


def nearest_cells(vectors: np.ndarray, centroids: list[Broadcast], n: int) -> np.ndarray:
    """The ``n`` nearest cells of each vector, nearest first; of equally near ones (to 6 places)
    the smaller cell. Fewer cells than ``n`` are all of them."""
    far = np.full((len(vectors), n), np.inf)
    found = np.full((len(vectors), n), np.iinfo(np.int64).max)

    def visit(group: Group, rows: np.ndarray) -> None:
        step = max(1, MATRIX_CELLS // len(group.cells))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            distance = -np.round(METRICS["l2"](vectors[part], group.centers), DIGITS)
            every = np.hstack([far[part], distance])
            cells = np.hstack([found[part], np.broadcast_to(group.cells, distance.shape)])
            order = np.lexsort((cells, every), axis=1)[:, :n]
            far[part] = np.take_along_axis(every, order, axis=1)
            found[part] = np.take_along_axis(cells, order, axis=1)

    total = 0
    for groups in opened(centroids):
        total += sum(len(g.cells) for g in groups)
        middles = np.stack([g.middle for g in groups])
        away = np.sqrt(-METRICS["l2"](vectors, middles))
        home = away.argmin(axis=1) if len(vectors) else np.empty(0, np.int64)
        for i, group in enumerate(groups):
            visit(group, np.flatnonzero(home == i))
        for i, group in enumerate(groups):
            least = np.maximum(away[:, i] - group.radius, 0) * (1 - 1e-6) - 1e-6
            possible = (home != i) & (np.maximum(least, 0) ** 2 <= far[:, -1] + 1e-6)
            visit(group, np.flatnonzero(possible))
    return found[:, : min(n, total)]


def _nearness(vectors: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Rounded minus squared distances, a block of vectors at a time."""
    step = max(1, MATRIX_CELLS // len(centroids))
    for at in range(0, len(vectors), step):
        part = slice(at, at + step)
        yield part, np.round(METRICS["l2"](vectors[part], centroids), DIGITS)


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Position of the nearest centroid; the first of equally near ones."""
    found = np.empty(len(vectors), np.int64)
    for part, near in _nearness(vectors, centroids):
        found[part] = near.argmax(axis=1)
    return found


def ivf_train(
    docs: DataFrame, n_list: int, seed: int = 42, vec_col: str = "embedding", max_iter: int = 20
) -> DataFrame:
    """``n_list`` centroids (``cell``, ``centroid``) by k-means over the vectors."""
    features = docs.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=n_list, seed=seed, maxIter=max_iter).fit(features)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return docs.sparkSession.createDataFrame(rows, CENTROIDS)


def ivf_train_two_level(
    docs: DataFrame,
    n_list: int,
    seed: int = 42,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    max_iter: int = 20,
) -> DataFrame:
    """About ``n_list`` centroids (``cell``, ``centroid``, ``parent``), more than one task could train
    or hold: the square root of them as parent cells by k-means, then as many centroids inside every
    parent, each parent on its own. A parent's centroids are trained on a bounded sample,
    ``PER_CENTROID`` vectors for each, with the least hashes of their ids. The centroids stay a
    table."""
    n_parents = max(1, math.isqrt(n_list))
    n_inner = -(-n_list // n_parents)
    parents = ivf_train(docs, n_parents, seed, vec_col, max_iter)
    dealt = ivf_assign(docs.select(id_col, vec_col), parents, vec_col)
    dealt = dealt.withColumn("_hash", F.xxhash64(id_col, F.lit(seed)))
    sample = top_k_per(dealt, "cell", "_hash", PER_CENTROID * n_inner, id_col).select("cell", vec_col)

    def train(table: pa.Table) -> pa.Table:
        parent, rows = table["cell"][0].as_py(), matrix(table[vec_col].combine_chunks())
        centers = _lloyd(rows, np.unique(rows, axis=0), n_inner, seed, max_iter)
        cells = np.arange(len(centers), dtype=np.int32) + parent * n_inner
        return pa.table(
            [
                pa.array(cells, pa.int32()),
                pa.array(list(centers), pa.list_(pa.float64())),
                pa.array(np.full(len(centers), parent, np.int32)),
            ],
            names=["cell", "centroid", "parent"],
        )

    return settle(sample.groupBy("cell").applyInArrow(train, CENTROIDS + ", parent INT"), "centroids")


def _lloyd(rows: np.ndarray, distinct: np.ndarray, k: int, seed: int, max_iter: int) -> np.ndarray:
    """At most ``k`` centers; they start at different vectors, and empty ones stay."""
    chosen = np.random.default_rng(seed).permutation(len(distinct))[:k]
    centers = distinct[np.sort(chosen)]
    for _ in range(max_iter):
        cell = _nearest(rows, centers)
        moved = centers.copy()
        for c in np.unique(cell):
            moved[c] = rows[cell == c].mean(axis=0)
        if np.allclose(moved, centers, atol=1e-9):
            break
        centers = moved
    return centers


def _with_cells(rows: DataFrame, sent: list[Broadcast], vec_col: str, n: int, schema: StructType, name: str):
    """``rows`` with the nearest cell, or a list of the ``n`` nearest, of each vector."""
    names = rows.columns
    at = names.index(vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = nearest_cells(matrix(batch.column(at)), sent, n).astype(np.int32)
            cells = pa.array(found[:, 0]) if n == 1 and name == "cell" else pa.array(list(found), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*names, name])

    return rows.mapInArrow(run, schema)


def ivf_assign(docs: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The documents with the ``cell`` of their nearest centroid."""
    rows = docs.drop("cell").filter(F.col(vec_col).isNotNull())
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType())])
    return _with_cells(rows, send_centroids(centroids), vec_col, 1, schema, "cell")


def probed(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """``query_id``, ``query_vec`` and ``cells``, the ``nprobe`` nearest ones."""
    rows = queries.select("query_id", "query_vec")
    schema = rows.withColumn("cells", F.lit(None).cast("array<int>")).schema
    return _with_cells(rows, send_centroids(centroids), "query_vec", nprobe, schema, "cells")


def write_cells(assigned: DataFrame, path: str) -> None:
    """Store assigned vectors one folder per cell, so a search reads only the cells it probes.
    Rebalancing brings a cell's vectors together and splits a crowded cell over many tasks."""
    assigned.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)


def _in_cells(df: DataFrame, probed_cells: set[int]) -> DataFrame:
    """Only the probed cells."""
    return df.filter(F.col("cell").isin(sorted(probed_cells)))


def ivf_knn(
    assigned: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    nprobe: int,
    k: int,
    metric: str = "l2",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """kNN over the ``nprobe`` nearest cells of each query. On a table stored with
    ``write_cells`` the cell filter prunes folders; no vector is shuffled."""
    sent = send(probed(queries, centroids, nprobe))
    near = _in_cells(assigned.select(id_col, vec_col, "cell"), sent.cells)
    return best_hits(near, sent, METRICS[metric], k)


def _codes(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest code per slot; ``book``: slots x codes x sub-dimensions."""
    width = book.shape[2]
    parts = [_nearest(vectors[:, i * width : (i + 1) * width], slot) for i, slot in enumerate(book)]
    return np.stack(parts, axis=1)


def pq_train(
    docs: DataFrame,
    m: int,
    n_codes: int = 256,
    iterations: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """A code book: ``n_codes`` centroids for each of ``m`` equal slices of the vectors.

    All slots are trained together. An iteration is one pass in which each task adds up its
    vectors per (slot, code), followed by an aggregation to at most m * n_codes rows. Starting
    points are the vectors with the smallest key hashes.
    """
    vectors = docs.select(id_col, vec_col).filter(F.col(vec_col).isNotNull())
    first = vectors.orderBy(F.xxhash64(id_col), id_col).limit(n_codes).select(vec_col).collect()
    start = np.array([r[0] for r in first], dtype=np.float64)
    if start.shape[1] % m:
        raise ValueError(f"{start.shape[1]} dimensions do not divide into {m} slots")
    book = start.reshape(len(start), m, -1).transpose(1, 0, 2)
    for _ in range(iterations):
        sums = vectors.select(vec_col).mapInArrow(
            _slot_sums(book), "slot INT, code INT, n BIGINT, total ARRAY<DOUBLE>"
        )
        width = book.shape[2]
        merged = sums.groupBy("slot", "code").agg(
            F.sum("n").alias("n"),
            *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)],
        )
        moved = book.copy()
        for r in merged.collect():
            moved[r["slot"], r["code"]] = [r[f"t{i}"] / r["n"] for i in range(width)]
        if np.allclose(moved, book, atol=1e-9):
            break
        book = moved
    rows = [
        (slot, code, [float(x) for x in book[slot, code]])
        for slot in range(book.shape[0])
        for code in range(book.shape[1])
    ]
    return docs.sparkSession.createDataFrame(rows, CODEBOOK)


def _slot_sums(book: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n_codes, width = book.shape
        counts = np.zeros((m, n_codes), np.int64)
        totals = np.zeros(book.shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column(0))
            codes = _codes(vectors, book)
            for slot in range(m):
                counts[slot] += np.bincount(codes[:, slot], minlength=n_codes)
                np.add.at(totals[slot], codes[:, slot], vectors[:, slot * width : (slot + 1) * width])
        slot, code = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slot.astype(np.int32)),
                pa.array(code.astype(np.int32)),
                pa.array(counts[slot, code]),
                pa.array(list(totals[slot, code]), type=pa.list_(pa.float64())),
            ],
            names=["slot", "code", "n", "total"],
        )

    return run


def _book(codebook: DataFrame) -> np.ndarray:
    """Slots x codes x sub-dimensions: as large as the caller's parameters make it."""
    rows = codebook.select("slot", "code", "centroid").collect()
    rows.sort(key=lambda r: (r["slot"], r["code"]))
    slots = 1 + rows[-1]["slot"]
    return np.array([r["centroid"] for r in rows], dtype=np.float64).reshape(slots, len(rows) // slots, -1)


def pq_encode(docs: DataFrame, codebook: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The documents with their vectors replaced by ``codes``, one small integer per slot."""
    book = _book(codebook)

    @F.pandas_udf("array<smallint>")
    def encode(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_codes(np.stack(vectors.to_numpy()), book).astype(np.int16)))

    coded = docs.filter(F.col(vec_col).isNotNull()).withColumn("codes", encode(F.col(vec_col)))
    return coded.drop(vec_col)


def residuals(assigned: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Assigned vectors relative to the centroid of their cell, the form a cell-wise product
    quantiser encodes. Centroids are joined by cell; Spark sends them whole where they are few and
    splits a crowded cell where they are not."""
    own = centroids.select(F.col("cell"), F.col("centroid").alias("_centroid"))
    gap = F.zip_with(F.col(vec_col), F.col("_centroid"), lambda x, c: x.cast("double") - c)
    return assigned.join(own, "cell").withColumn(vec_col, gap).drop("_centroid")


def _table_scores(book: np.ndarray):
    """Minus the squared L2 distance between queries and coded vectors, from one table lookup
    per slot (Jegou et al. 2011)."""
    width = book.shape[2]

    def score(codes: np.ndarray, queries: np.ndarray, cell: int | None = None) -> np.ndarray:
        picked = codes.astype(np.int64)
        total = np.zeros((len(codes), len(queries)))
        for slot in range(book.shape[0]):
            part = queries[:, slot * width : (slot + 1) * width]
            table = METRICS["l2"](book[slot], part)
            total += table[picked[:, slot]]
        return total

    return score


def _cell_scores(book: np.ndarray, centroids: list[Broadcast]):
    """``_table_scores`` for codes of residuals: the distance of query q to centroid c plus code b
    is |q - c|^2 + (|b|^2 + 2 bc) - 2 bq. The bracket belongs to the cell and is added up once per
    vector, the last term is one table per slot, so a query needs no row of its own per cell."""
    width = book.shape[2]
    squares = (book * book).sum(axis=2)
    last: dict[int, np.ndarray] = {}

    def center_of(cell: int) -> np.ndarray:
        if cell not in last:
            last.clear()
            for groups in opened(centroids):
                for group in groups:
                    if cell in group.cells:
                        last.update(zip(group.cells.tolist(), group.centers, strict=True))
        return last[cell]

    def score(codes: np.ndarray, queries: np.ndarray, cell: int) -> np.ndarray:
        picked = codes.astype(np.int64)
        center = center_of(cell)
        far = ((queries - center) ** 2).sum(axis=1)
        own, total = np.zeros(len(codes)), np.zeros((len(codes), len(queries)))
        for slot in range(book.shape[0]):
            part = slice(slot * width, (slot + 1) * width)
            own += (squares[slot] + 2 * book[slot] @ center[part])[picked[:, slot]]
            total += (2 * book[slot] @ queries[:, part].T)[picked[:, slot]]
        return -np.maximum(far[None, :] + own[:, None] - total, 0.0)

    return score


def pq_knn(
    coded: DataFrame,
    queries: DataFrame,
    codebook: DataFrame,
    k: int,
    centroids: DataFrame | None = None,
    nprobe: int = 1,
    id_col: str = "vec_id",
) -> DataFrame:
    """kNN by L2 over coded vectors. With ``centroids`` the codes are those of ``residuals``
    and only the ``nprobe`` nearest cells of a query are searched; queries and centroids are all
    that is sent to the tasks."""
    book = _book(codebook)
    if centroids is None:
        asked = queries.select("query_id", "query_vec")
        return best_hits(coded.select(id_col, "codes"), send(asked), _table_scores(book), k)
    sent = send(probed(queries, centroids, nprobe))
    near = _in_cells(coded.select(id_col, "codes", "cell"), sent.cells)
    return best_hits(near, sent, _cell_scores(book, send_centroids(centroids)), k)
