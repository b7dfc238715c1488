"""Vector code compression: product codes trained exactly, with norm-of-sum bounds.

Vectors are cut into parts, and each part position has a codebook. A round assigns every part to
its nearest entry and moves every entry to the floored mean of its parts. Most parts keep their
entry from round to round, and bounds prove it without measuring them again: for each part the
exact distances to its own and to its second entry are kept, with a stamp of the round they were
measured in. All codebooks since are kept too, so the bounds of a later round use how far each
entry really is from where it stood at the stamp (the norm of the sum of its moves), which is never
more than the length of the way it went. Own distance plus own displacement, below second distance
less the largest displacement of another entry, settles the part; only others are rescanned.

Distances are whole numbers. A bound is a float and has to clear a margin well above its rounding, so
codes are those of a full scan, ties to the lower entry. The state of a round is written and
the one before dropped. Sums are carried on: only parts that change their entry are added up,
one row for each part and entry leaves a task, and parts x entries x components come to the driver.
That and the codebooks of all rounds depend on the parameters, not on the table.

Vectors that are null or hold null or non-finite components are not returned. Of different lengths
the most frequent one (of equals the longest) is coded; vectors of other lengths are returned with
null code and error. Lengths that the parts do not divide give the first parts one component more.
Repeated rows count as often as they stand; rows without id can be entries only after all others.
Fewer vectors than entries give as many entries. An empty table gives an empty table. Components of
2**27 or more after scaling are an error. Columns of the input that have the name of a result are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from paperlode.llm.centroids import finite, whole_numbers
from paperlode.llm.common import unused
from paperlode.session import drop_scratch, scratch_made, settle

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Parts that are rescanned together.
ROWS = 4_096
#: Stands for the second distance where there is one entry only.
NONE = 1 << 62
#: Far above the rounding of square roots and sums of the bounds, far below the steps of distances.
MARGIN = 1e-9


def edges(size: int, parts: int) -> list[int]:
    """Where parts begin, and the end."""
    return [0, *np.cumsum([size // parts + (p < size % parts) for p in range(parts)]).tolist()]


Codebooks = list[np.ndarray]  # for each part: entries x components


@dataclass
class Bounds:
    """Codebooks of all rounds so far, and how far entries are from where they stood."""

    history: list[Codebooks]

    def __post_init__(self):
        now = self.history[-1]
        moved = [
            [np.sqrt(((book - then[p]) ** 2).sum(axis=1).astype(np.float64)) for p, book in enumerate(now)]
            for then in self.history
        ]
        #: (round, part, entry): own displacement, and the largest of all other entries.
        self.own = np.array(moved)
        self.other = np.zeros_like(self.own)
        for e in range(self.own.shape[2]):
            rest = np.delete(self.own, e, axis=2)
            if rest.shape[2]:
                self.other[:, :, e] = rest.max(axis=2)

    def settled(self, part: int, code, stamp, near, second) -> np.ndarray:
        """Whose entry is nearest without measuring again."""
        upper = np.sqrt(near.astype(np.float64)) + self.own[stamp, part, code]
        lower = np.sqrt(second.astype(np.float64)) - self.other[stamp, part, code]
        return upper * (1 + MARGIN) + MARGIN < lower * (1 - MARGIN)


def rescanned(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry, and exact squared distances to it and to the next."""
    code, near, second = [], [], []
    for s in range(0, len(rows), ROWS):
        gap = rows[s : s + ROWS, None, :] - book[None]
        far = (gap * gap).sum(axis=2)
        best = far.argmin(axis=1)
        at = np.arange(len(far))
        code.append(best)
        near.append(far[at, best])
        far[at, best] = NONE
        second.append(far.min(axis=1))
    return np.concatenate(code), np.concatenate(near), np.concatenate(second)


@dataclass
class State:
    """For each vector and part: entry, entry of the round before, stamp, exact distances."""

    code: np.ndarray
    before: np.ndarray
    stamp: np.ndarray
    near: np.ndarray
    second: np.ndarray

    FIELDS = ("code", "before", "stamp", "near", "second")

    @staticmethod
    def read(column: pa.Array, parts: int) -> State:
        found = [column.field(c).flatten().to_numpy(zero_copy_only=False) for c in State.FIELDS]
        return State(*(f.astype(np.int64).reshape(-1, parts) for f in found))

    def write(self) -> pa.Array:
        kinds = [pa.int16()] * 3 + [pa.int64()] * 2
        columns = [
            pa.array(list(getattr(self, c)), pa.list_(t)) for c, t in zip(State.FIELDS, kinds, strict=True)
        ]
        return pa.StructArray.from_arrays(columns, names=list(State.FIELDS))

    TYPE = "struct<code:array<short>,before:array<short>,stamp:array<short>,near:array<long>,second:array<long>>"


def advanced(state: State | None, rows: np.ndarray, bounds: Bounds, cut: list[int]) -> tuple[State, int]:
    """The state by the newest codebooks, and how many parts were rescanned."""
    now, parts = len(bounds.history) - 1, len(cut) - 1
    if state is None:
        shape = (len(rows), parts)
        state = State(np.full(shape, -1), np.full(shape, -1), *(np.zeros(shape, np.int64) for _ in range(3)))
    new = State(state.code.copy(), state.code, state.stamp.copy(), state.near.copy(), state.second.copy())
    measured = 0
    for p in range(parts):
        known = state.code[:, p] >= 0
        args = (state.code[:, p], state.stamp[:, p], state.near[:, p], state.second[:, p])
        left = np.nonzero(~(known & bounds.settled(p, *args)))[0]
        if len(left):
            found = rescanned(rows[left, cut[p] : cut[p + 1]], bounds.history[-1][p])
            new.code[left, p], new.near[left, p], new.second[left, p] = found
            new.stamp[left, p] = now
            measured += len(left)
    return new, measured


def _assign(rows: DataFrame, vector: str, state: str, history: list[Codebooks], scale: int, first: bool) -> DataFrame:
    cut = edges(sum(b.shape[1] for b in history[0]), len(history[0]))
    names = [c for c in rows.columns if c != state]
    schema = rows.drop(state).withColumn(state, F.lit(None).cast(State.TYPE)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        for batch in batches:
            at = batch.schema.get_field_index
            old = None if first else State.read(batch.column(at(state)), len(cut) - 1)
            new, _ = advanced(old, whole_numbers(batch.column(at(vector)), scale), bounds, cut)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(at(c)) for c in names], new.write()], names=[*names, state]
            )

    return rows.mapInArrow(run, schema)


def changes(rows: DataFrame, vector: str, state: str, books: Codebooks, scale: int) -> list[list[list[int]]]:
    """For every part and entry: by how much its count and its sums by component change."""
    entries, parts = len(books[0]), len(books)
    cut = edges(sum(b.shape[1] for b in books), parts)
    moved = rows.filter(F.col(f"{state}.code") != F.col(f"{state}.before")).select(vector, state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((entries, 1 + cut[p + 1] - cut[p]), np.int64) for p in range(parts)]
        for batch in batches:
            x, own = whole_numbers(batch.column(0), scale), State.read(batch.column(1), parts)
            for p in range(parts):
                new, old = own.code[:, p], own.before[:, p]
                row = np.nonzero(new != old)[0]
                counted = np.hstack([np.ones((len(row), 1), np.int64), x[row, cut[p] : cut[p + 1]]])
                np.add.at(total[p], new[row], counted)
                known = old[row] >= 0
                np.subtract.at(total[p], old[row[known]], counted[known])
        part, entry = np.divmod(np.arange(parts * entries), entries)
        sums = [total[p][e] for p, e in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(sums, pa.list_(pa.int64()))],
            names=["part", "entry", "total"],
        )

    partial = moved.mapInArrow(run, "part long, entry long, total array<long>")
    each = partial.select("part", "entry", F.posexplode("total").alias("at", "x")).filter("x <> 0")
    out = [[[0] * (1 + cut[p + 1] - cut[p]) for _ in range(entries)] for p in range(parts)]
    for r in each.groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).collect():
        out[r["part"]][r["entry"]][r["at"]] = r["x"]
    return out


@dataclass
class Codes:
    """Coded rows and the codebooks that they are coded by."""

    rows: DataFrame
    books: Codebooks

    def digest(self) -> str:
        """Of all entries' components, by part, entry and place, as decimals between commas."""
        numbers = (str(x) for book in self.books for x in book.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codes:
    """The rows with ``code`` (hexadecimal, two digits for each part) and ``error`` (squared
    distances to the entries, added up), and the codebooks after ``rounds`` rounds."""
    if not 1 <= entries <= 256:
        raise ValueError("two hexadecimal digits hold up to 256 entries")
    spark = vectors.sparkSession
    kept = settle(vectors.drop("code", "error").filter(finite(F.col(vector))), "coded")
    lengths = kept.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    null = {"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")}
    if top is None:
        return Codes(kept.withColumns(null), [])
    size, state = top["d"], unused(kept, "state")
    rows = kept.filter(F.size(vector) == size)
    chosen = rows.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    first = whole_numbers(pa.array([r[0] for r in chosen], pa.list_(pa.float64())), scale)
    cut = edges(size, parts)
    history = [[first[:, cut[p] : cut[p + 1]] for p in range(parts)]]
    totals = [[[0] * (1 + cut[p + 1] - cut[p]) for _ in range(len(first))] for p in range(parts)]

    stored, made = rows, []
    for t in range(rounds):
        with scratch_made() as own:
            stored = settle(_assign(stored, vector, state, history, scale, t == 0), "codes")
        change = changes(stored, vector, state, history[-1], scale)
        drop_scratch(spark, made)
        made = own
        if not any(x for part in change for entry in part for x in entry):
            break  # no part moved, so no entry does, in this round or later
        new = [book.copy() for book in history[-1]]
        for p, part in enumerate(change):
            for e, delta in enumerate(part):
                totals[p][e] = [a + b for a, b in zip(totals[p][e], delta, strict=True)]
                if totals[p][e][0]:
                    new[p][e] = [x // totals[p][e][0] for x in totals[p][e][1:]]
        history.append(new)
    coded = _coded(stored, vector, state, history, scale, first=stored is rows)
    rest = kept.filter(F.size(vector) != size).withColumns(null)
    return Codes(coded.unionByName(rest), history[-1])


def _coded(rows: DataFrame, vector: str, state: str, history: list[Codebooks], scale: int, first: bool) -> DataFrame:
    """Assigned once more, as code and error. A part that its bounds settle is not rescanned: its
    distance is measured to its own entry only."""
    cut = edges(sum(b.shape[1] for b in history[0]), len(history[0]))
    names = [c for c in rows.columns if c != state]
    kept = [f for f in rows.schema.fields if f.name != state]
    schema = StructType([*kept, StructField("code", StringType()), StructField("error", LongType())])
    books = history[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        for batch in batches:
            at = batch.schema.get_field_index
            x = whole_numbers(batch.column(at(vector)), scale)
            old = None if first else State.read(batch.column(at(state)), len(books))
            code = advanced(old, x, bounds, cut)[0].code
            error = np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                gap = x[:, cut[p] : cut[p + 1]] - book[code[:, p]]
                error += (gap * gap).sum(axis=1)
            text = [bytes(c).hex() for c in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(at(c)) for c in names], pa.array(text, pa.string()), pa.array(error)],
                names=[*names, "code", "error"],
            )

    return rows.mapInArrow(run, schema)


def decoded(code: Column, books: Codebooks, scale: int = SCALE) -> Column:
    """The vector of a code's entries, the middle of each step."""

    @F.pandas_udf("array<double>")
    def udf(code):
        def vector(c):
            if c is None:
                return None
            found = [book[e] for book, e in zip(books, bytes.fromhex(c), strict=True)]
            return (np.concatenate(found) + 0.5) / scale

        return code.map(vector)

    return udf(code)


def with_label_error(rows: DataFrame, label: str) -> DataFrame:
    """Coded rows with ``label_error``: errors added up over equal labels, nulls together."""
    stored = settle(rows.drop("label_error"), "errors")
    own = unused(stored, "own_label")
    sums = stored.groupBy(F.col(label).alias(own)).agg(F.sum("error").alias("label_error"))
    return stored.join(sums, stored[label].eqNullSafe(sums[own])).drop(own)
