"""Exact substring deduplication by suffix sorting.

Every byte that a repeated string of ``WINDOW`` bytes covers is removed; strings may repeat in the
same document, and are judged on the input.

Which suffixes are sorted. Every window of ``WINDOW`` bytes holds an anchor: a gram of ``GRAM``
bytes whose hash is least among the window's grams, so equal windows have equal anchors at equal
offsets. An anchor's context is all that windows with this gram can cover. Counts over the whole
corpus settle most anchors: if no other anchor has the gram, none of its windows repeats through
it; if another one has the whole context, all do. Only where a gram occurs in different contexts
(near the ends of repeated passages) are the suffixes that start at each byte before the gram
compared; of equal contexts one takes part. The contexts of a gram that very many of them share are
cut into cells first: ``CELL`` windows in a row, with all bytes that they have in common as their
token instead of the gram. Counts of cells, as hashes and places only, settle most of them again: a
cell whose token is nowhere else repeats nothing, cells that are equal as a whole repeat everything.
One of each equal cells takes part in the comparison, if its token is in other cells too.

How they are sorted. Suffixes are dealt out by range on their leading token (the hash of the
gram or of what a cell has in common), with splitters that Spark samples, and a second key splits a token that fills several
buckets. A bucket sorts its suffixes by multikey quicksort on tokens of 100 bytes (64-bit hashes):
by the first token, then runs of equals by the next. Equal neighbours repeat. The first and last
leading token of a bucket may go on in the next one; their suffixes are compared once more across
buckets.

Texts are known by two 64-bit hashes. Null text is empty. Texts shorter than a window lose
nothing; equal texts of a window or more lose everything. Repeated rows count as copies. An empty
table gives an empty table. Columns of the input that have the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from paperlode.llm.common import handing_back, unused
from paperlode.session import settle

WINDOW = 200
GRAM = 64
SPREAD = WINDOW - GRAM  # an anchor is at most so far from the start of its window
TOKEN = WINDOW // 2
#: Window starts of a text that are worked on at once, and contexts that a bucket sorts at once.
SEGMENT = 1 << 18
#: Contexts of one gram from which they are cut into cells, and windows of a cell.
CROWD = 64
CELL = 12
#: Bytes of texts that are worked on at once.
PART = 1 << 21
ROWS = 1_500

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers have inverses


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def row(x: int) -> np.ndarray:
        out = np.full(size, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(base), row(pow(base, -1, 1 << 64))


@lru_cache(maxsize=2)
def _letters(base: int) -> np.ndarray:
    """A random number for each byte value."""
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any stretches of a byte array, by sums of powers."""

    def __init__(self, body: np.ndarray, base: int):
        size = 1 << max(len(body), SEGMENT + 4 * WINDOW).bit_length()
        self.powers, self.back = _powers(base, size)
        self.sums = np.zeros(len(body) + 1, dtype=np.uint64)
        np.cumsum(_letters(base)[body] * self.powers[: len(body)], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        at = self.back[start]
        return _mixed((self.sums[end] - self.sums[start]) * at)


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of every ``width`` values in a row, by doubling."""
    size, out = 1, values
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: places, hashes of grams, hashes of contexts."""
    n = len(body)
    places, grams, contexts = [], [], []
    for s in range(0, n - WINDOW + 1, SEGMENT):
        e = min(s + SEGMENT, n - WINDOW + 1)  # windows s .. e - 1
        low, high = max(0, s - SPREAD), min(n, e - 1 + SPREAD + WINDOW)
        part = body[low:high]
        hashed = Hashes(part, BASES[0])
        count = e - s + SPREAD
        first = slice(s - low, s - low + count)
        g = hashed(first, slice(first.start + GRAM, first.stop + GRAM))
        least = _sliding(g, SPREAD + 1, np.minimum)
        padded = np.zeros(len(least) + 2 * SPREAD, dtype=np.uint64)
        padded[SPREAD : SPREAD + len(least)] = least
        at = np.nonzero(_sliding(padded, SPREAD + 1, np.maximum) == g)[0]
        p = at + s
        left, right = np.maximum(p - SPREAD, 0), np.minimum(p + WINDOW, n)
        second = Hashes(part, BASES[1])
        with np.errstate(over="ignore"):
            shape = ((p - left) * 1024 + (right - left)).astype(np.uint64)
            c = second(left - low, right - low) ^ (shape * np.uint64(BASES[0]))
        places.append(p)
        grams.append(g[at])
        contexts.append(c)
    if not places:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    p, at = np.unique(np.concatenate(places), return_index=True)
    return (
        p,
        np.concatenate(grams)[at].view(np.int64),
        np.concatenate(contexts)[at].view(np.int64),
    )


ANCHORS = "h long, ctx long, k1 long, k2 long, pos long"


def slices(batch: pa.RecordBatch, column: int | str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PART`` bytes in one of its columns, or of one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy()
    part = np.cumsum(sizes.astype(np.int64)) // PART
    starts = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0] if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield batch.slice(a, b - a)


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        buffer = x.as_buffer()
        yield np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            found = [anchors(b) for b in _bytes(part.column(2))]
            sizes = [len(p) for p, _, _ in found]
            columns = [np.concatenate([f[k] for f in found]) for k in (1, 2)]
            columns += [np.repeat(part.column(k).to_numpy(), sizes) for k in (0, 1)]
            columns.append(np.concatenate([f[0] for f in found]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["h", "ctx", "k1", "k2", "pos"]
            )


CELLS = "h long, w long, k1 long, k2 long, pos long, size long, single boolean"


def _cells(bodies: list[bytes], gram: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts, with the places of their grams, in cells by the bytes before the gram that a window
    covers, ``low`` to ``high``: number of the context, hash of what all windows of the cell cover, hash
    of what any of them covers, where the cell begins, its size. Equal windows have equal anchors, so
    they are in the same cell of each."""
    sizes = np.array([len(b) for b in bodies])
    joined = np.frombuffer(b"".join(bodies), np.uint8)
    base = (np.cumsum(sizes) - sizes)[:, None]
    low = np.arange(0, SPREAD + 1, CELL)
    high = np.minimum(low + CELL - 1, SPREAD)
    before, after = gram[:, None] - high, gram[:, None] - low
    a, b = np.maximum(before, 0), np.minimum(after, (sizes - WINDOW)[:, None])
    row, cell = np.nonzero(a <= b)
    first, last, common, end = (x[row, cell] for x in (base + a, base + b + WINDOW, base + after, base + before + WINDOW))
    with np.errstate(over="ignore"):
        token = Hashes(joined, BASES[0])(common, end) ^ _mixed((low[cell] + 1).astype(np.uint64) * np.uint64(BASES[1]))
        whole = Hashes(joined, BASES[1])(first, last) ^ ((last - first).astype(np.uint64) * np.uint64(BASES[0]))
    return row, token.view(np.int64), whole.view(np.int64), a[row, cell], last - first


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, body, asked) to the cells of each context. A cell's place is where a gram would be that
    has the cell's first window as the first of its context."""
    kinds = [*[pa.int64()] * 6, pa.bool_()]
    for part in _contexts(batches):
        for s in range(0, part.num_rows, ROWS):
            rows = part.slice(s, ROWS)
            k1, k2, pos, single = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "pos", "single"))
            left = np.maximum(pos - SPREAD, 0)
            row, token, whole, begin, size = _cells(rows.column("body").to_pylist(), pos - left)
            place = left[row] + begin + SPREAD
            columns = (token, whole, k1[row], k2[row], place, size, single[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["h", "w", "k1", "k2", "pos", "size", "single"],
            )


CONTEXTS = "h long, k1 long, k2 long, pos long, single boolean, body binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, body, asked: array of (pos, h, single, stop)) to one row for each context or cell; of
    equal texts in a task one is taken."""
    names = ["h", "k1", "k2", "pos", "single", "body"]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
    seen = set()
    for batch in batches:
        for part in slices(batch, "body"):
            rows = [[] for _ in names]
            for k1, k2, body, asked in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                for x in asked:
                    pos = x["pos"]
                    found = (x["h"], k1, k2, pos, x["single"], body[max(0, pos - SPREAD) : x["stop"]])
                    for column, v in zip(rows, found, strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names
            )


def multikey_order(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their tokens, and where runs of equal suffixes start in it.

    Quicksort on one token; runs of equals, and only they, are sorted on by the next one.
    """
    order = np.argsort(tokens[0], kind="quicksort")
    edge = np.ones(len(order), dtype=bool)
    edge[1:] = tokens[0][order[1:]] != tokens[0][order[:-1]]
    for token in tokens[1:]:
        run = np.cumsum(edge) - 1
        tied = np.nonzero(np.bincount(run, minlength=1)[run] > 1)[0]
        if not len(tied):
            break
        inner = np.lexsort((token[order[tied]], run[tied]))
        order[tied] = order[tied][inner]
        later = token[order[tied[1:]]] != token[order[tied[:-1]]]
        edge[tied[1:]] |= later
    return order, np.nonzero(edge)[0]


BUCKET = "kind int, k1 long, k2 long, a long, b long, t1 long, t2 long"


def _bucket_rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    full = list(columns) + [np.zeros(n, np.int64)] * (6 - len(columns))
    arrays = [pa.array(np.full(n, kind, np.int32)), *[pa.array(c.astype(np.int64)) for c in full]]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "k1", "k2", "a", "b", "t1", "t2"])


def _resolve(part: dict[str, np.ndarray], bodies: list[bytes], border: np.ndarray):
    """Sort the suffixes of some contexts. Kind 0: stretches (a, b) that repeat. Kind 1: suffixes
    at a, of leading tokens on the border, that are still alone. Kind 2: one suffix of each that
    repeats, of leading tokens on the border."""
    sizes = np.array([len(b) for b in bodies])
    counts = sizes - WINDOW + 1
    joined = Hashes(np.frombuffer(b"".join(bodies), np.uint8), BASES[1])
    row = np.repeat(np.arange(len(bodies)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[row] + offset
    t1, t2 = joined(at, at + TOKEN), joined(at + TOKEN, at + WINDOW)
    start = np.maximum(part["pos"] - SPREAD, 0)[row] + offset
    with np.errstate(over="ignore"):
        place = _mixed(
            (part["k1"].astype(np.uint64) + part["k2"].astype(np.uint64) * np.uint64(BASES[0]))[row]
            + start.astype(np.uint64) * np.uint64(BASES[1])
        )
    order, edges = multikey_order([t1, t2])
    run_of = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(order))))
    first = np.minimum.reduceat(place[order], edges)
    last = np.maximum.reduceat(place[order], edges)
    copied = np.bitwise_or.reduceat(~part["single"][row][order], edges)
    repeats = np.empty(len(order), dtype=bool)
    repeats[order] = ((first != last) | copied)[run_of]

    mine = repeats & part["single"][row]
    r, s = row[mine], start[mine]
    begins = np.ones(len(r), dtype=bool)
    begins[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
    b = np.nonzero(begins)[0]
    if len(b):
        ends = np.append(b[1:], len(r)) - 1
        yield _bucket_rows(0, part["k1"][r[b]], part["k2"][r[b]], s[b], s[ends] + WINDOW)
    open_ = border[row]
    alone = np.nonzero(open_ & ~repeats)[0]
    lead = np.zeros(len(order), dtype=bool)
    lead[order[edges]] = True
    shown = np.nonzero(lead & repeats)[0]
    shown = shown[np.isin(part["h"][row[shown]], part["h"][border])] if border.any() else shown[:0]
    for kind, x in ((1, alone), (2, shown)):
        if len(x):
            yield _bucket_rows(
                kind,
                part["k1"][row[x]],
                part["k2"][row[x]],
                start[x],
                start[x] + WINDOW,
                t1[x].view(np.int64),
                t2[x].view(np.int64),
            )


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by leading token. A token of more contexts than are sorted at once is cut,
    and its pieces meet where buckets do."""
    names = ("h", "k1", "k2", "pos", "single")
    held: dict[str, np.ndarray] | None = None
    bodies: list[bytes] = []
    open_tokens: list[int] = []

    def cut(n: int):
        nonlocal held, bodies
        part = {c: held[c][:n] for c in names}
        yield from _resolve(part, bodies[:n], np.isin(part["h"], open_tokens))
        held, bodies = {c: held[c][n:] for c in names}, bodies[n:]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
        bodies += batch.column("body").to_pylist()
        if not open_tokens:
            open_tokens.append(int(held["h"][0]))
        while len(bodies) > ROWS:
            end = int(np.searchsorted(held["h"], held["h"][ROWS]))
            if not end:  # one token fills all that is sorted at once
                open_tokens.append(int(held["h"][0]))
                end = ROWS
            yield from cut(end)
    if held is not None and len(bodies):
        open_tokens.append(int(held["h"][-1]))
        yield from cut(len(bodies))


def _merged(a: list[int], b: list[int], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(a, b, strict=True)):
        e = min(e, n)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def readable(kept: Column) -> Column:
    """The bytes as text, without the parts of letters that a cut left over."""

    @F.pandas_udf("string")
    def udf(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")

    return udf(kept)


def _keys(text: Column) -> dict[str, Column]:
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text)}


def _members(cells: DataFrame) -> DataFrame:
    """The cells whose token is in more than one place, with whether they are ``copied`` as a whole, and
    whether they are the ``first`` of their kind and have to be compared with others of their token."""
    place = F.xxhash64("k1", "k2", "pos")
    places = [F.min(place).alias("least"), F.max(place).alias("most"), F.min("single").alias("alone")]
    tokens = cells.groupBy("h").agg(*places, (F.min("w") != F.max("w")).alias("mixed"))
    shared = settle(tokens.filter("least <> most or not alone").select("h", "mixed"), "shared")
    held = cells.join(shared, "h")
    kinds = held.groupBy("h", "w").agg(*places)
    kinds = kinds.select("h", "w", "least", ((F.col("least") != F.col("most")) | ~F.col("alone")).alias("copied"))
    first = F.col("mixed") & (place == F.col("least"))
    return held.join(kinds, ["h", "w"]).withColumn("first", first).drop("w", "least", "mixed")


def repeated_stretches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, stretches: array of (a, b)): what repeats, for each text by its two hashes."""
    body = F.coalesce(F.col(text), F.lit(""))
    bodies = docs.select(*[c.alias(n) for n, c in _keys(body).items()], body.cast("binary").alias("body"))
    long = bodies.filter(F.octet_length("body") >= WINDOW)
    found = long.select("k1", "k2", "body").mapInArrow(handing_back(_find), ANCHORS)

    contexts = found.groupBy("h", "ctx").agg(F.count("*").alias("n"))
    grams = contexts.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("n_ctx"))
    often = contexts.join(grams.filter("total > 1"), "h").select("h", "ctx", "n", "n_ctx")
    often = settle(often, "contexts")
    marked = settle(found.join(often, ["h", "ctx"]), "anchors")

    whole = marked.filter("n > 1").select(
        "k1", "k2", F.greatest(F.lit(0), F.col("pos") - SPREAD).alias("a"), (F.col("pos") + WINDOW).alias("b")
    )
    place = F.struct("k1", "k2", "pos")
    asked = (
        marked.filter("n_ctx > 1")
        .groupBy("h", "ctx")
        .agg(F.min(place).alias("p"), F.max(F.col("n") == 1).alias("single"), F.max(F.col("n_ctx") > CROWD).alias("crowded"))
        .select("h", "p.*", "single", (F.col("p.pos") + WINDOW).alias("stop"), "crowded")
    )
    asked = settle(asked, "asked")

    def beside(rows: DataFrame) -> DataFrame:
        """Texts with what is asked of them."""
        lists = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "h", "single", "stop")).alias("asked"))
        return long.join(lists, ["k1", "k2"]).select("k1", "k2", "body", "asked")

    cells = settle(beside(asked.filter("crowded")).mapInArrow(handing_back(_cut), CELLS), "cells")
    members = settle(_members(cells), "members")
    begin = F.col("pos") - SPREAD
    equal = members.filter("copied and single").select("k1", "k2", begin.alias("a"), (begin + F.col("size")).alias("b"))
    lone = members.filter("first").select("h", "k1", "k2", "pos", (~F.col("copied")).alias("single"), (begin + F.col("size")).alias("stop"))
    left = asked.filter("not crowded").drop("crowded").unionByName(lone)
    cut = settle(beside(left).mapInArrow(handing_back(_contexts), CONTEXTS), "cut")
    dealt = cut.repartitionByRange("h", "k1").sortWithinPartitions("h", "k1", "k2", "pos")
    sorted_ = settle(dealt.mapInArrow(handing_back(_bucket), BUCKET), "buckets")

    border = sorted_.filter("kind > 0")
    at = F.struct("k1", "k2", "a")
    across = border.groupBy("t1", "t2").agg(
        F.max("kind").alias("most"), F.min(at).alias("least"), F.max(at).alias("largest")
    )
    across = across.filter("most = 2 or least <> largest").select("t1", "t2")
    later = border.filter("kind = 1").join(across, ["t1", "t2"], "left_semi")
    stretches = whole.union(equal).union(sorted_.filter("kind = 0").select("k1", "k2", "a", "b"))
    stretches = stretches.union(later.select("k1", "k2", "a", "b"))
    return stretches.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("stretches"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay) and ``removed`` (runs of removed bytes, as
    (start, end), in order)."""
    docs = docs.drop("kept", "removed")
    stretches = settle(repeated_stretches(docs, text), "stretches")
    k1, k2, found = (unused(docs, c) for c in ("k1", "k2", "stretches"))
    stretches = stretches.withColumnsRenamed({"k1": k1, "k2": k2, "stretches": found})
    keys = _keys(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.withColumns({k1: keys["k1"], k2: keys["k2"]})
    joined = keyed.join(stretches, [k1, k2], "left").drop(k1, k2)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                names = [c for c in part.schema.names if c != found]
                kept, removed = [], []
                bodies = part.column(part.schema.names.index(text)).to_pylist()
                for body, runs in zip(bodies, part.column(part.schema.names.index(found)).to_pylist(), strict=True):
                    raw = (body or "").encode()
                    spans = _merged([r["a"] for r in runs or ()], [r["b"] for r in runs or ()], len(raw))
                    pieces, at = [], 0
                    for a, b in spans:
                        pieces.append(raw[at:a])
                        at = b
                    kept.append(b"".join([*pieces, raw[at:]]))
                    removed.append([{"start": a, "end": b} for a, b in spans])
                columns = [part.column(part.schema.names.index(c)) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(kept, pa.binary()), pa.array(removed, span)],
                    names=[*names, "kept", "removed"],
                )

    kind = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    spans = docs.select(kind.alias("removed")).schema["removed"]
    schema = StructType([*docs.schema.fields, StructField("kept", BinaryType()), spans])
    return joined.select(*docs.columns, found).mapInArrow(handing_back(run), schema)
