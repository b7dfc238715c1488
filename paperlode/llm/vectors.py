"""Approximate nearest neighbours by an adaptive scan of dimensions inside probed lists.

Largest inner products become least distances: a vector gets one more component, so that all have
the length of the longest one. Vectors and queries are turned by a random rotation, after which
every block of columns is a random sample of the whole distance. A list is scanned block by
block; after each block a hypothesis test compares the distance so far, scaled up, with the
query's bound, and abandons what is very unlikely to come below it. Survivors are scored exactly
on the original vectors.

Lists are cells around centroids that are trained on a bounded sample (``SAMPLE`` rows); every
row is indexed. The bound of a query is its k-th best distance in that sample; its nearest lists
that hold k vectors together are scanned without abandoning, so that no query comes back short.

Lists that are neighbours in order are bundled up to ``PIECE`` rows, and longer ones are dealt out in
pieces. A query is sent once to a bundle with the lists that it probes there, and its hits of a
bundle are merged before they leave the task, so neither its copies nor its hits grow with the
number of lists. Bundles that very many queries probe are scanned for groups of queries.

Vectors that are null, zero, hold null or non-finite components, or do not have the most frequent
length, take no part; the last ones are counted in a warning. Equal vectors are ranked by id;
repeated rows of an id are ranked as often as they stand in the table. An id asks once: of its rows the
least vector. Fewer candidates than k are all returned. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.session import settle

SAMPLE = 20_000
PROBED = 0.7
#: Columns scanned before the first, second, ... test, as shares of all.
BLOCKS = (0.25, 0.5, 0.75)
#: Width of the test: 2.6 abandons a vector below the bound about once in ten thousand.
WIDTH = 2.6
PIECE = 4_096
#: Queries that are scanned for together, and the share of a tile below which single pairs go on.
ASKING = 256
SPARSE = 0.05


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def rotation(size: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def trained(sample: np.ndarray, n_lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), n_lists, replace=False)].copy()
    for _ in range(rounds):
        cell = nearest(sample, centres, 1)[:, 0]
        for c in np.unique(cell):
            centres[c] = sample[cell == c].mean(axis=0)
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(a: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((len(a), n), dtype=np.int64)
    for s in range(0, len(a), 4096):
        d = distances(a[s : s + 4096], centres)
        out[s : s + 4096] = np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def survivors(
    turned_queries: np.ndarray, turned: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of a list that no test abandons. ``bounds`` are squared distances,
    infinite where nothing may be abandoned. A block of columns is one matrix product for the
    whole list; once few pairs are left, they go on alone."""
    size = turned.shape[1]
    stops = sorted({max(1, round(size * b)) for b in BLOCKS} | {size})

    def loose(high: int) -> float:
        return ((1 + WIDTH / math.sqrt(high)) ** 2 if high < size else 1 + 1e-9) * high / size

    far, low, alive = np.zeros((len(turned_queries), len(turned))), 0, None
    for at, high in enumerate(stops):
        far += distances(turned_queries[:, low:high], turned[:, low:high])
        alive = far <= (loose(high) * bounds)[:, None]
        low = high
        if np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    q, x = np.nonzero(alive)
    rest = far[q, x]
    for high in stops[at + 1 :]:
        step = turned_queries[q, low:high] - turned[x, low:high]
        rest = rest + (step * step).sum(axis=1)
        on = rest <= loose(high) * bounds[q]
        q, x, rest, low = q[on], x[on], rest[on], high
    return q, x


def best(
    query_ids: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, score: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each query, without the query's own id."""
    other = query_ids[q] != ids[x]
    q, x, score = q[other], x[other], score[other]
    order = np.lexsort((ids[x], -score, q))
    q, x, score = q[order], x[order], score[order]
    begin = np.nonzero(np.concatenate([[True], q[1:] != q[:-1]]))[0] if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return query_ids[q[rank < k]], ids[x[rank < k]], score[rank < k]


def bundled(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its bundle and the pieces of that bundle: lists in order up to ``PIECE`` rows
    together, longer lists alone and in pieces."""
    bundle, pieces = np.zeros(len(count), np.int64), np.ones(len(count), np.int64)
    current, held = 0, 0
    for c, n in enumerate(count.tolist()):
        if held and held + n > PIECE:
            current, held = current + 1, 0
        bundle[c], held = current, held + n
        pieces[c] = max(1, -(-n // PIECE))
    return bundle, pieces


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    probed: float = PROBED,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other ids."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    own = vectors.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    own = own.filter(usable(F.col("v")) & F.col("id").isNotNull())
    lengths = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return spark.createDataFrame([], empty)
    d, n = top["d"], top["n"]
    odd = (lengths.agg(F.sum("n")).first()[0] or 0) - n
    if odd:
        warnings.warn(f"{odd} vectors do not have {d} components and take no part", stacklevel=2)
    own = own.filter(F.size("v") == d)
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    longest = own.agg(F.max(square)).first()[0]

    # Rows with the least hashes of their ids: a sample that reruns agree on.
    at = F.xxhash64("id", F.lit(7))
    taken = own.orderBy(at, "id").limit(min(SAMPLE, n)).select("id", "v").toPandas()
    sample = np.array(taken["v"].tolist())
    turn = rotation(d + 1)

    def lifted(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]]) @ turn

    def asked(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.zeros((len(x), 1))]) @ turn

    n_lists = max(1, min(math.isqrt(n), len(sample) // 8))
    centres = trained(lifted(sample), n_lists)
    n_probed = max(1, min(n_lists, max(8, math.ceil(probed * n_lists))))
    bound_ids, bound = taken["id"].to_numpy(), lifted(sample)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = nearest(lifted(_matrix(b.column(1))), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), *b.columns], names=["cell", "id", "v", "asks"]
                )

    listed = settle(own.mapInArrow(index, "cell long, id long, v array<double>, asks boolean"), "lists")
    count = np.zeros(n_lists, dtype=np.int64)
    for row in listed.groupBy("cell").count().collect():
        count[row["cell"]] = row["count"]

    bundle, pieces = bundled(count)
    shared = spark.sparkContext.broadcast((centres, bound_ids, bound))  # SAMPLE rows at most

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, bound_ids, bound = shared.value
        own_row = np.argsort(bound_ids, kind="stable")
        sorted_ids = bound_ids[own_row]
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids, q = part.column(0).to_numpy(), asked(_matrix(part.column(1)))
                cells = nearest(q, centres, n_lists)
                held = np.cumsum(count[cells], axis=1) - count[cells]
                far = distances(q, bound)
                low, high = np.searchsorted(sorted_ids, ids), np.searchsorted(sorted_ids, ids, "right")
                for i in np.nonzero(high > low)[0]:
                    far[i, own_row[low[i] : high[i]]] = np.inf
                limit = np.full(len(q), np.inf)
                if far.shape[1] >= k:
                    limit = np.partition(far, k - 1, axis=1)[:, k - 1]
                free = held <= k  # nothing is abandoned in these lists
                wanted = ((np.arange(n_lists) < n_probed) | free) & (count[cells] > 0)
                row, rank = np.nonzero(wanted)
                list_, open_ = cells[row, rank], free[row, rank]
                order = np.lexsort((list_, bundle[list_], row))
                row, list_, open_ = row[order], list_[order], open_[order]
                edge = np.ones(len(row), dtype=bool)
                edge[1:] = (row[1:] != row[:-1]) | (bundle[list_[1:]] != bundle[list_[:-1]])
                first = np.nonzero(edge)[0]
                ends = np.append(first, len(row)).astype(np.int32)
                # A list without abandoning is written as its complement, below zero.
                listed_ = pa.array(np.where(open_, ~list_, list_).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bundle[list_[first]]),
                        pa.array(ids[row[first]]),
                        part.column(1).take(pa.array(row[first])),
                        pa.array(limit[row[first]]),
                        pa.ListArray.from_arrays(pa.array(ends), listed_),
                    ],
                    names=["bundle", "id", "v", "bound", "cells"],
                )

    probes = listed.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    kinds = "bundle long, id long, v array<double>, bound double, cells array<int>"
    probes = settle(probes.mapInArrow(probe, kinds), "probes")

    asking = {r["bundle"]: r["count"] for r in probes.groupBy("bundle").count().collect()}
    plan = {int(b): (int(pieces[bundle == b].max()), max(1, -(-asking.get(int(b), 0) // PIECE))) for b in set(bundle)}
    lists = [(c, int(bundle[c]), *plan[int(bundle[c])]) for c in range(n_lists)]
    table = spark.createDataFrame(lists, "cell long, bundle long, pieces int, groups int")
    each = F.broadcast(table)  # one row for each list
    one = F.broadcast(table.select("bundle", "pieces", "groups").distinct())

    def dealt(rows: DataFrame, mine: str, theirs: str) -> DataFrame:
        """Own piece by hash of the id, one copy for each piece of the other side."""
        salted = rows.withColumn(
            mine, F.pmod(F.xxhash64("id", F.lit(mine)), F.col(f"{mine}s")).cast("int")
        )
        return salted.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"{theirs}s") - 1)))

    keys = ["bundle", "piece", "group"]
    left = dealt(listed.select("cell", "id", "v").join(each, "cell"), "piece", "group")
    right = dealt(probes.join(one, "bundle"), "group", "piece")

    def near(vectors_: pa.Table, queries_: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        if not vectors_.num_rows or not queries_.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        order = np.argsort(vectors_["cell"].to_numpy(), kind="stable")
        cell = vectors_["cell"].to_numpy()[order]
        x, ids = _matrix(vectors_["v"])[order], vectors_["id"].to_numpy()[order]
        turned, found = lifted(x), []
        present, start = np.unique(cell, return_index=True)
        end = np.append(start[1:], len(cell))
        for s in range(0, queries_.num_rows, ASKING):
            part = queries_.slice(s, ASKING)
            q, query_ids = _matrix(part["v"]), part["id"].to_numpy()
            turned_q, bounds = asked(q), part["bound"].to_numpy()
            cells = part["cells"].combine_chunks()
            who = np.repeat(np.arange(len(q)), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten().to_numpy()
            list_ = np.where(flat < 0, ~flat, flat)
            pairs = []
            for c, a, b in zip(present.tolist(), start.tolist(), end.tolist(), strict=True):
                mine = np.nonzero(list_ == c)[0]
                if len(mine):
                    rows = who[mine]
                    limit = np.where(flat[mine] < 0, np.inf, bounds[rows])
                    hit, at = survivors(turned_q[rows], turned[a:b], limit)
                    pairs.append((rows[hit], at + a))
            if not pairs:
                continue
            qi, xi = (np.concatenate([p[k_] for p in pairs]) for k_ in range(2))
            score = np.empty(len(qi))
            for t in range(0, len(qi), 65_536):
                score[t : t + 65_536] = (q[qi[t : t + 65_536]] * x[xi[t : t + 65_536]]).sum(axis=1)
            found.append(best(query_ids, ids, qi, xi, score, k))
        return pa.table(
            [
                pa.array(np.concatenate([f[i] for f in found]) if found else [], t)
                for i, t in enumerate(kinds)
            ],
            names=names,
        )

    left = left.select(*keys, "cell", "id", "v").groupBy(*keys)
    right = right.select(*keys, "id", "v", "bound", "cells").groupBy(*keys)
    hits = left.cogroup(right).applyInArrow(near, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def recall(found: pd.DataFrame, exact: pd.DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    pairs = ["query_id", "vec_id"]
    return len(found[pairs].merge(exact[pairs])) / max(1, len(exact))
