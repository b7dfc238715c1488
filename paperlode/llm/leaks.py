"""Benchmark decontamination: windows of benchmark words found in whole documents.

The windows of a block of benchmark items (all runs of ``WINDOW`` words; an item of fewer words is
one window) are a hash set that is broadcast. A document's words become the numbers they have in
the block's vocabulary, words that the block lacks become 0, and only runs of known words are
looked up. A hit of the hash set is verified word by word. Words that a hit covers are removed as
spans, or the whole document goes.

Only a bounded block is broadcast: at most ``BLOCK`` bytes of words, whatever the benchmark's size.
Items stream through the driver into blocks, a long item in segments that overlap by a window, and
the documents are scanned once for each block, so a benchmark of many blocks costs passes, not
memory. A word above ``LONG`` bytes stands in a block as its digest.

A-Z count as a-z. Null, empty and wordless texts have no words, are never hit and hit nothing.
Items are told apart by their ids: rows of equal id are one item, rows without id are one item that
is counted and not listed. Equal documents are judged alike and stay rows. Without items, nothing
is hit; an empty table gives an empty table. Columns of the input that have the name of a result
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperlode.session import settle

WINDOW = 10
#: Bytes of benchmark words that are broadcast at once, and words of an item in one segment.
BLOCK = 32 << 20
SEGMENT = 4_096
#: Longer words are known by their digest.
LONG = 64
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20

#: A word's bytes are 0-9, a-z and all of non-ASCII letters; A-Z become a-z, others a blank.
LETTERS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32
    for c in range(256)
)


def _short(word: bytes) -> bytes:
    """The word, or a digest that no word can be."""
    return word if len(word) <= LONG else b" " + hashlib.sha256(word).digest()


def pieces_of_words(text: str | None) -> Iterator[list[bytes]]:
    """All words of a text in order, in pieces."""
    body = (text or "").encode().translate(LETTERS)
    at = 0
    while at < len(body):
        end = body.find(b" ", at + PIECE)
        end = len(body) if end < 0 else end
        found = body[at:end].split()
        if end - at > LONG and found and len(max(found, key=len)) > LONG:
            found = [_short(w) for w in found]
        yield found
        at = end


def word_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words (first, last + 1) as bytes of the text."""
    blank = np.frombuffer((text or "").encode().translate(LETTERS), np.uint8) == 32
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.nonzero(edge < 0)[0], np.nonzero(edge > 0)[0]
    return [(int(start[a]), int(end[b - 1])) for a, b in spans]


Segment = tuple[str | None, list[bytes]]


def segments(items: Iterable[tuple[str | None, str | None]], window: int) -> Iterator[Segment]:
    """(id, words): an item's words, a long item's in pieces that share a window but one word."""
    for item, text in items:
        held: list[bytes] = []
        cut = False
        for piece in pieces_of_words(text):
            held += piece
            while len(held) >= SEGMENT + window:
                yield item, held[:SEGMENT]
                held, cut = held[SEGMENT - window + 1 :], True
        if held and (not cut or len(held) >= window):
            yield item, held


def blocks(found: Iterator[Segment]) -> Iterator[list[Segment]]:
    """Segments that together have at most ``BLOCK`` bytes, or one segment."""
    held, size = [], 0
    for item, body in found:
        n = sum(map(len, body)) + 32 * len(body)
        if held and size + n > BLOCK:
            yield held
            held, size = [], 0
        held.append((item, body))
        size += n
    if held:
        yield held


def _mixing(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


@dataclass
class Grams:
    """The distinct windows of one length, sorted by hash: where each stands in the block's
    ``words``, and its items."""

    length: int
    words: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    first: np.ndarray
    items: np.ndarray
    crowd: int

    @staticmethod
    def of(length: int, words: np.ndarray, start: np.ndarray, items: np.ndarray, letters: np.ndarray) -> Grams:
        rows = words[start[:, None] + np.arange(length)]
        distinct, shown, place = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        hashes = np.zeros(len(distinct), dtype=np.uint64)
        for j, m in enumerate(_mixing(length, length)):
            hashes += letters[distinct[:, j]] * m
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[place.ravel()], items], axis=1), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        hashes = hashes[order]
        _, same = np.unique(hashes, return_counts=True)
        return Grams(length, words, hashes, start[shown[order]], first, pairs[:, 1], int(same.max()))

    def hits(self, numbers: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all windows that stand in the numbered words; 0 is in none."""
        n = self.length
        none = np.empty(0, dtype=np.int64)
        if len(numbers) < n:
            return none, none
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        at = np.nonzero(known[n:] - known[:-n] == n)[0]
        if not len(at):
            return none, none
        hashes = np.zeros(len(at), dtype=np.uint64)
        for j, m in enumerate(_mixing(n, n)):
            hashes += letters[numbers[at + j]] * m
        low = np.searchsorted(self.hashes, hashes)
        found = []
        for k in range(self.crowd):  # windows that only share a hash stand side by side
            row = np.minimum(low + k, len(self.hashes) - 1)
            like = np.nonzero(self.hashes[row] == hashes)[0]
            place, row = at[like], row[like]
            real = np.ones(len(place), dtype=bool)
            for j in range(n):
                real &= self.words[self.start[row] + j] == numbers[place + j]
            found.append((place[real], row[real]))
        return np.concatenate([p for p, _ in found]), np.concatenate([r for _, r in found])


class Block:
    """What is broadcast: a vocabulary, windows by length and item ids."""

    def __init__(self, found: list[Segment], window: int):
        self.vocabulary: dict[bytes, int] = {}
        names: dict[str | None, int] = {}
        words, starts, owners, at = [], {}, {}, 0
        for item, body in found:
            who = names.setdefault(item, len(names))
            words.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in body])
            n = min(window, len(body))
            count = len(body) - n + 1
            starts.setdefault(n, []).append(np.arange(at, at + count))
            owners.setdefault(n, []).append(np.full(count, who))
            at += len(body)
        every = np.array([n for body in words for n in body], dtype=np.int32)
        self.items = list(names)
        self.letters = _mixing(len(self.vocabulary) + 1, 0)
        self.grams = [
            Grams.of(n, every, np.concatenate(starts[n]), np.concatenate(owners[n]), self.letters)
            for n in sorted(starts)
        ]

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        found = [np.fromiter(map(get, p, repeat(0)), np.int32, len(p)) for p in pieces_of_words(text)]
        return np.concatenate(found) if found else np.empty(0, np.int32)

    def judged(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], list]]:
        """For each text: number of words, spans of hit words, ids of items with hits."""
        found = [self.numbers(t) for t in texts]
        start = np.cumsum([0] + [len(f) + 1 for f in found])
        joined = np.zeros(start[-1], dtype=np.int32)
        for s, f in zip(start, found):
            joined[s : s + len(f)] = f  # a 0 stands between texts
        cover = np.zeros(len(joined) + 1, dtype=np.int64)
        who = []
        for grams in self.grams:
            place, row = grams.hits(joined, self.letters)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + grams.length, -1)
            # (text, window) once each, then the window's items
            text = np.searchsorted(start, place, side="right") - 1
            pairs = np.unique(text * len(grams.hashes) + row)
            text, row = pairs // len(grams.hashes), pairs % len(grams.hashes)
            n = grams.first[row + 1] - grams.first[row]
            at = np.repeat(grams.first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who.append(np.repeat(text, n) * len(self.items) + grams.items[at])
        who = np.unique(np.concatenate(who)) if who else np.empty(0, dtype=np.int64)
        hit = np.cumsum(cover) > 0
        edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        begins, ends = np.nonzero(edge > 0)[0], np.nonzero(edge < 0)[0]
        span = np.searchsorted(begins, start)
        item = np.searchsorted(who, np.arange(len(texts) + 1) * len(self.items))
        for i, f in enumerate(found):
            own = range(span[i], span[i + 1])
            listed = [self.items[w % len(self.items)] for w in who[item[i] : item[i + 1]]]
            yield len(f), [(int(begins[j] - start[i]), int(ends[j] - start[i])) for j in own], listed


def union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


RESULT = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"


def _scan(docs: DataFrame, text: str, block: Block, first: bool) -> DataFrame:
    """``docs`` with the results of one more block."""
    made = ["n_words", "n_hit", "spans", "items"]
    own = [f for f in docs.schema.fields if f.name not in made]
    names = [f.name for f in own]
    schema = StructType([*own, *StructType.fromDDL(RESULT).fields])
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                at = part.schema.get_field_index
                rows = list(known.judged(part.column(at(text)).to_pylist()))
                if not first:
                    before = zip(part.column(at("spans")).to_pylist(), part.column(at("items")).to_pylist())
                    rows = [
                        (n, union(spans, [(x["start"], x["end"]) for x in old]), [*{*items, *listed}])
                        for (n, spans, items), (old, listed) in zip(rows, before, strict=True)
                    ]
                spans = [[{"start": a, "end": b} for a, b in r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(at(c)) for c in names],
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([sum(b - a for a, b in r[1]) for r in rows], pa.int64()),
                        pa.array(spans, kind),
                        pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    ],
                    names=[*names, *made],
                )

    return docs.mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words in any hit), ``spans`` (runs of hit words, from
    the first to before the last) and ``items`` (ids, as strings, of items with a hit window)."""
    docs = docs.drop("n_words", "n_hit", "spans", "items")
    told = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    told = told.filter("t is not null").distinct()
    streamed = ((r["i"], r["t"]) for r in told.toLocalIterator())
    out = None
    for found in blocks(segments(streamed, window)):
        out = _scan(docs if out is None else settle(out, "leaks"), text, Block(found, window), out is None)
    return _scan(docs, text, Block([], window), True) if out is None else out


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents of ``find_leaks`` without the words that hits cover, and what lies between
    them; what stands before and after a span stays as it is."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        def rest(t, s):
            if t is None or not len(s):
                return t
            body, out, at = t.encode(), [], 0
            for a, b in word_spans(t, [(x["start"], x["end"]) for x in s]):
                out.append(body[at:a])
                at = b
            return b"".join([*out, body[at:]]).decode()

        return texts.combine(spans, rest)

    return found.withColumn(text, F.when(F.size("spans") > 0, cut(F.col(text), F.col("spans"))).otherwise(F.col(text)))


def without_documents(found: DataFrame, share: float = 0.0) -> DataFrame:
    """The documents of ``find_leaks`` of whose words at most ``share`` are hit."""
    return found.filter(F.col("n_hit") <= F.lit(share) * F.col("n_words"))


def listing(items: Column) -> Column:
    """The ids, sorted as strings and joined by commas; rows without id are not listed."""
    return F.array_join(F.array_sort(F.filter(items, lambda x: x.isNotNull())), ",")
