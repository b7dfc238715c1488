"""Centroid clustering of integer vectors, assigned by the threshold algorithm.

Each dimension has the centroids in a list sorted by their component. A vector enters every list at
its own value and walks outward, list after list, always to the nearer side. A centroid that turns
up for the first time is measured exactly. What no list has shown yet is at least as far as the
next step of every list together, so the walk stops as soon as the squares of these frontier
steps add up to strictly more than the best exact distance; an equal sum may still hide an equal
distance of a smaller number. Everything is whole numbers, so results do not depend on how the rows
are dealt out.

A round is one pass: a task adds up its vectors by cluster, one row for each cluster leaves it,
and only ``k`` x ``size`` sums come to the driver. The centroids are the model; its size is the
caller's ``k`` x ``size`` numbers, whatever the table's.

Vectors that are null, have another length than ``size``, or hold null or non-finite components take
no part and are not returned. Repeated rows count as often as they stand. Rows without id can be
centroids only after all others. Fewer vectors than ``k`` give as many centroids; centroids that are
equal go by the smaller number. An empty table gives an empty table. Components of 2**27 or more
after scaling are an error, as squared distances would not fit a long. Columns of the input that
have the name of a result are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from paperlode.llm.common import unused
from paperlode.session import settle

#: Vectors that walk together, and the largest component that can be squared and added up.
ROWS = 2_048
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether there is a vector without null and non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vector.isNotNull() & ~bad


def whole_numbers(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * component)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(scale * values)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise OverflowError(f"components of {LARGEST} or more after scaling cannot be squared in a long")
    return scaled.astype(np.int64).reshape(len(column), -1)


class Lists:
    """The centroids, and for every dimension their numbers in the order of their components."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k, size = centroids.shape
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)
        # The lists that tell the centroids apart best are walked first.
        self.turns = np.argsort(-centroids.astype(float).std(axis=0), kind="stable")

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid, and how many exact
        distances that took."""
        who, best, measured = [], [], 0
        for s in range(0, len(rows), ROWS):
            w, b, m = self._walk(rows[s : s + ROWS])
            who.append(w)
            best.append(b)
            measured += m
        none = np.empty(0, np.int64)
        return np.concatenate(who or [none]), np.concatenate(best or [none]), measured

    def _walk(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        k, size = self.centroids.shape
        far = np.iinfo(np.int64).max
        who, best = np.full(len(rows), k), np.full(len(rows), far)
        seen = np.zeros((len(rows), k), dtype=bool)
        high = np.stack([np.searchsorted(self.values[d], rows[:, d]) for d in range(size)], axis=1)
        low = high - 1
        step = np.stack([self._next(d, rows[:, d], low[:, d], high[:, d]) for d in range(size)], axis=1)
        frontier = (step * step).sum(axis=1)
        on = np.arange(len(rows))
        measured = turn = 0
        while len(on):
            d = self.turns[turn % size]
            turn += 1
            x, a, b = rows[on, d], low[on, d], high[on, d]
            down = (a >= 0) & ((b >= k) | (x - self.values[d, np.maximum(a, 0)] <= self.values[d, np.minimum(b, k - 1)] - x))
            shown = self.order[d, np.where(down, a, b)]
            new = ~seen[on, shown]
            row, centroid = on[new], shown[new]
            seen[row, centroid] = True
            gap = rows[row] - self.centroids[centroid]
            exact = (gap * gap).sum(axis=1)
            measured += len(row)
            better = (exact < best[row]) | ((exact == best[row]) & (centroid < who[row]))
            best[row[better]], who[row[better]] = exact[better], centroid[better]
            a, b = a - down, b + ~down
            low[on, d], high[on, d] = a, b
            ended = (a < 0) & (b >= k)  # a list is through, so every centroid has been measured
            further = self._next(d, x, a, b)
            frontier[on] += further * further - step[on, d] * step[on, d]
            step[on, d] = further
            on = on[~ended & (frontier[on] <= best[on])]
        return who, best, measured

    def _next(self, d: int, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How far a list's next centroid is, on the nearer side."""
        k = self.values.shape[1]
        none = 2 * LARGEST
        below = np.where(low >= 0, x - self.values[d, np.maximum(low, 0)], none)
        above = np.where(high < k, self.values[d, np.minimum(high, k - 1)] - x, none)
        return np.minimum(below, above)


def first_centroids(rows: DataFrame, vec_id: str, vector: str, k: int, scale: int) -> np.ndarray:
    """The vectors of the ``k`` ids with the smallest digests; equal ids go by their components."""
    name = F.sha2(F.concat(F.lit("1:"), F.col(vec_id).cast("string")), 256)
    chosen = rows.orderBy(name.asc_nulls_last(), vector).limit(k).select(vector).collect()
    if not chosen:
        return np.empty((0, 0), np.int64)
    return whole_numbers(pa.array([r[0] for r in chosen], pa.list_(pa.float64())), scale)


def sums(rows: DataFrame, vector: str, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, list[int]]]:
    """For every cluster with vectors: how many, and their sums by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = whole_numbers(batch.column(0), scale)
            who, _, _ = lists.nearest(x)
            np.add.at(count, who, 1)
            np.add.at(total, who, x)
        used = np.nonzero(count)[0]
        # The count goes as one more component.
        both = np.hstack([count[used, None], total[used]])
        columns = [pa.array(used), pa.array(list(both), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "total"])

    partial = rows.select(vector).mapInArrow(run, "cluster long, total array<long>")
    parts = partial.select("cluster", F.posexplode("total").alias("at", "x"))
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["cluster"], {})[r["at"]] = r["x"]
    return {c: (x[0], [x[j] for j in range(1, len(x))]) for c, x in found.items()}


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    size: int = 64,
    scale: int = 64,
) -> tuple[DataFrame, np.ndarray]:
    """The rows that take part, with ``cluster`` (number of the nearest centroid) and ``distance``
    (squared, to it), and the centroids after ``rounds`` rounds."""
    vectors = vectors.drop("cluster", "distance")
    rows = settle(vectors.filter(finite(F.col(vector)) & (F.size(vector) == size)), "clustered")
    plain = unused(rows, "plain")
    centroids = first_centroids(rows, vec_id, vector, k, scale)
    for _ in range(rounds if len(centroids) else 0):
        for c, (count, total) in sums(rows, vector, centroids, scale).items():
            centroids[c] = [x // count for x in total]
    schema = StructType(
        [*rows.schema.fields, StructField("cluster", IntegerType()), StructField("distance", LongType())]
    )
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            part = batch.column(batch.schema.get_field_index(plain))
            who, best, _ = lists.nearest(whole_numbers(part, scale))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(who, pa.int32()), pa.array(best)], names=[*names, "cluster", "distance"]
            )

    if not len(centroids):
        none = rows.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long"))
        return none, centroids
    return rows.withColumn(plain, F.col(vector)).mapInArrow(run, schema), centroids


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster``'s rows with ``cluster_inertia``, ``inertia`` (distances summed over the cluster
    and over all) and ``centroid_sha256``. The table of clusters has ``k`` rows, hence the broadcast."""
    rows = settle(clustered.drop("cluster_inertia", "inertia", "centroid_sha256"), "assigned")
    key = unused(rows, "own")
    found = rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    total = sum(r["s"] for r in found)
    names = digests(centroids)
    table = rows.sparkSession.createDataFrame(
        [(r["cluster"], r["s"], total, names[r["cluster"]]) for r in found],
        f"`{key}` int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(table), rows["cluster"] == table[key]).drop(key)
