"""SimHash near-duplicates by anchor-point covering.

A fingerprint's halves are covered by the words of a Hamming code: every 31 bits are within one
bit of exactly one anchor (covering radius 1). Two fingerprints with 3 or fewer differing bits
differ in at most one bit in one of their halves, so the anchor nearest to one of them is within
covering radius plus that one bit of the other. Each fingerprint is replicated to every anchor
within 2 bits in each half, and fingerprints are compared anchor by anchor.

With several fingerprints of a text, the anchors of all halves bring texts together, and all bits
of all fingerprints decide: the differing bits estimate the angle between the texts' shingle
counts, and so their similarity. One fingerprint of 64 bits within 3 bits asks for 0.95 or so; this
also links texts of similarity 0.8.

Equal fingerprints are one node, so copies are not compared. An anchor with very many
fingerprints is dealt out anew by the four parts of the other half, one of which two linked
fingerprints have in common. In a group, a search that drops whatever it has reached gives links
that connect the same fingerprints as all links would.

Null and empty texts, and texts of blanks, have fingerprint zero and are linked like any other. A
null id is kept; it is a component's id only if the component has no other. Rows that are equal
stay rows. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from paperlode.llm.common import handing_back, unused
from paperlode.llm.components import components
from paperlode.session import settle

SEED = 42
THRESHOLD = 3
#: Fingerprints of one anchor that one task compares before the group is dealt out anew.
GROUP = 20_000
SMALL = 16
#: Of a text's fingerprints, those whose bits are compared; the others only bring texts together.
COMPARED = 4


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of all windows of ``size`` words, A-Z in lower case; of all words if there are fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64)
    body = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(body[a:b], SEED) for a, b in spans), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits that are set in over half of the hashes; as a signed number."""
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * count > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


#: One bit of each of a number's eight bytes, and how many such bytes add up without carry.
LANES = np.uint64(0x0101010101010101)
CARRY = 255


def majorities(hashes: np.ndarray, prints: int) -> list[int]:
    """``majority`` of each of ``prints`` hashes of the same shingles. Eight bits of all of them are
    counted at once, each in its own byte of a number, for up to 255 numbers before a byte is full."""
    out = np.zeros((prints, 64), dtype=np.uint64)
    for s in range(0, len(hashes), CARRY << 6):
        part = hashes[s : s + (CARRY << 6)]
        room = -(-len(part) // CARRY) * CARRY
        mixed = np.zeros((prints, room), dtype=np.uint64)
        mixed[0, : len(part)] = part
        if prints > 1:
            mixed[1:, : len(part)] = remixed(part, np.arange(1, prints, dtype=np.uint64)[:, None])
        for bit in range(8):
            lanes = ((mixed >> np.uint64(bit)) & LANES).reshape(prints, -1, CARRY).sum(axis=2)
            out[:, bit::8] += lanes.astype("<u8").view(np.uint8).reshape(prints, -1, 8).sum(axis=1)
    bits = (2 * out > len(hashes)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def remixed(hashes: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Another hash of the same shingles, or a row for each of several; hash 0 is the hash itself."""
    if np.ndim(k) == 0 and not k:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.asarray(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(text: Column, size: int = 3, prints: int = 1) -> Column:
    """``prints`` independent fingerprints of whole texts, as an array of signed numbers."""

    @F.pandas_udf("array<long>")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = (shingle_hashes(t, size) for t in batch)
            yield pd.Series([[majority(remixed(h, k)) for k in range(prints)] for h in found])

    return udf(text)


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _syndromes(bits: np.ndarray) -> np.ndarray:
    """Place of the bit (from 1) that leads to the nearest word of the code; 0 for a word."""
    out = np.zeros(len(bits), dtype=np.int64)
    for k in range(31):
        out ^= np.where((bits >> k) & 1, k + 1, 0)
    return out


def anchors(prints: np.ndarray) -> np.ndarray:
    """All anchors of each fingerprint: 2 halves of 16, as numbers that hold half and word."""
    out = np.empty((len(prints), 32), dtype=np.int64)
    for half in range(2):
        bits = (prints.astype(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0x7FFFFFFF
        s = _syndromes(bits)
        home = np.where(s > 0, bits ^ (1 << np.maximum(s - 1, 0)), bits)
        out[:, 16 * half] = home | (half << 40)
        # Flipping bits i and j leads to a word if their places add up to the syndrome.
        filled = np.ones(len(prints), dtype=np.int64)
        for i in range(1, 32):
            j = s ^ i
            ok = (s > 0) & (j > i)
            word = bits ^ (1 << (i - 1)) ^ (1 << np.maximum(j - 1, 0))
            rows = np.nonzero(ok)[0]
            out[rows, 16 * half + filled[rows]] = word[rows] | (half << 40)
            filled[rows] += 1
        rest = s == 0  # a word itself: no other word is within 2 bits
        out[rest, 16 * half + 1 : 16 * half + 16] = -1
    return out


def _parts(prints: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Four keys of each fingerprint for a crowded anchor: its key and 8 bits of the other half."""
    other = np.where(keys >> 40 & 1, 0, 32).astype(np.uint64)
    bits = (prints.astype(np.uint64) >> other).astype(np.int64) & 0xFFFFFFFF
    return np.stack(
        [keys | (1 << 41) | (k << 42) | ((bits >> (8 * k) & 0xFF) << 44) for k in range(4)], axis=1
    )


def _near(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    differing = np.bitwise_count((a ^ b).astype(np.uint64))
    return (differing if differing.ndim == 1 else differing.sum(axis=1)) <= threshold


def _spanning(prints: np.ndarray, threshold: int, near_by=_near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a group as all of its links would: what is reached is searched from and
    not compared again."""
    found, rest = [], prints
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            frontier = queue.pop()
            for x in frontier:
                near = near_by(rest, x, threshold)
                if near.any():
                    reached = rest[near]
                    found.append((np.broadcast_to(x, reached.shape), reached))
                    queue.append(reached)
                    rest = rest[~near]
                    if not len(rest):
                        break
    return found


class _Prints:
    """Rows that are fingerprints only."""

    near, group = staticmethod(_near), staticmethod(_spanning)

    @staticmethod
    def node(rows: np.ndarray) -> np.ndarray:
        return node_of(rows)


def _compare(keys: np.ndarray, prints: np.ndarray, threshold: int, judge):
    """Links within runs of equal keys."""
    start = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    length = np.diff(np.append(start, len(keys)))
    found = []
    for s, n in zip(start[length > SMALL], length[length > SMALL], strict=True):
        found += judge.group(prints[s : s + n], threshold)
    small = np.repeat(length <= SMALL, length)
    k, p = keys[small], prints[small]
    for lag in range(1, SMALL):
        same = np.nonzero(k[lag:] == k[:-lag])[0]
        if not len(same):
            break
        near = same[judge.near(p[same], p[same + lag], threshold)]
        found.append((p[near], p[near + lag]))
    return found


LINKS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _out(key, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b)], schema=LINKS)


def node_of(prints: np.ndarray) -> np.ndarray:
    """A text's node: its only fingerprint, or a 64-bit hash of all of them."""
    if prints.ndim == 1:
        return prints
    node = np.zeros(len(prints), dtype=np.uint64)
    for k in range(prints.shape[1]):
        node = remixed(node ^ np.ascontiguousarray(prints[:, k]).view(np.uint64), k + 1)
    return node.view(np.int64)


def _prints(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """The columns from ``first`` on: fingerprints, or rows of them if there are several."""
    found = [c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]]
    return found[0] if len(found) == 1 else np.stack(found, axis=1)


def _compare_sorted(batches, threshold: int, limit: int | None, judge=_Prints):
    """Sorted (key, print...) rows to links of nodes; the rows of a key beyond ``limit`` come out
    again as (key, node, null). Only the last key of a batch is held back."""
    keys, prints = np.empty(0, np.int64), None
    crowded = None

    def leftover(k, p):
        return pa.RecordBatch.from_arrays(
            [pa.array(k), pa.array(judge.node(p)), pa.nulls(len(p), pa.int64())], schema=LINKS
        )

    def links(k, p):
        found = _compare(k, p, threshold, judge) if len(k) else []
        a = np.concatenate([judge.node(x) for x, _ in found] or [np.empty(0, np.int64)])
        b = np.concatenate([judge.node(y) for _, y in found] or [np.empty(0, np.int64)])
        return _out(np.zeros(len(a), np.int64), np.minimum(a, b), np.maximum(a, b))

    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        p = _prints(batch, 1)
        if crowded is not None:
            more = k == crowded
            if more.any():
                yield leftover(k[more], p[more])
                k, p = k[~more], p[~more]
            if not len(k):
                continue
            crowded = None
        keys = np.concatenate([keys, k])
        prints = p if prints is None else np.concatenate([prints, p])
        if not len(keys):
            continue
        tail = np.searchsorted(keys, keys[-1])
        if limit is not None:
            start = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
            length = np.diff(np.append(start, len(keys)))
            full = np.repeat(length > limit, length)
            if full.any():
                yield leftover(keys[full], prints[full])
                crowded = keys[-1] if full[-1] else None
                ended = ~full & (np.arange(len(keys)) < tail)
                yield links(keys[ended], prints[ended])
                held = ~full & (np.arange(len(keys)) >= tail)
                keys, prints = keys[held], prints[held]
                continue
        if tail:
            yield links(keys[:tail], prints[:tail])
            keys, prints = keys[tail:], prints[tail:]
    if len(keys):
        yield links(keys, prints)


def _dealt(rows: DataFrame, threshold: int, limit: int | None, judge=_Prints) -> DataFrame:
    schema = "key long, a long, b long"
    dealt = rows.repartition("key").sortWithinPartitions(*rows.columns)
    return settle(dealt.mapInArrow(handing_back(lambda b: _compare_sorted(b, threshold, limit, judge)), schema), "near")


def near_links(prints: DataFrame, threshold: int = THRESHOLD, limit: int = GROUP) -> DataFrame:
    """``prints``: distinct fingerprints in a column ``print``. Links (a, b), a < b, that connect
    the same fingerprints as all pairs with at most ``threshold`` (up to 3) differing bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("the two halves cover up to 3 differing bits")

    def covered(batches):
        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False)
            for s in range(0, len(p), 50_000):
                part = p[s : s + 50_000]
                keys = anchors(part)
                real = keys.ravel() >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()[real]), pa.array(np.repeat(part, 32)[real])],
                    names=["key", "print"],
                )

    def parted(batches):
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            p = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_parts(p, k).ravel()), pa.array(np.repeat(p, 4))], names=["key", "print"]
            )

    rows = prints.select("print").mapInArrow(covered, "key long, print long")
    first = _dealt(rows, threshold, limit)
    crowded = first.filter("b is null").select("key", "a").mapInArrow(parted, "key long, print long")
    second = _dealt(crowded, threshold, None)
    both = first.filter("b is not null").select("a", "b").union(second.select("a", "b"))
    return both.distinct()


class _Rows:
    """Rows of (node, prints...): which are near, which links of a group to give."""

    @staticmethod
    def near(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
        return _near(a[..., 1:], b[..., 1:], threshold)

    @staticmethod
    def group(rows: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return _spanning(rows, threshold, _Rows.near)

    @staticmethod
    def node(rows: np.ndarray) -> np.ndarray:
        return rows[:, 0]


#: Nodes that a task remembers while it drops links.
REMEMBERED = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) without those between nodes that earlier links of the task connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        kept = []
        for at, (a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append(at)
        yield batch.take(pa.array(kept, pa.int64()))
        if len(root) > REMEMBERED:
            root.clear()


def proposed(nodes: DataFrame, prints: int, threshold: int, limit: int = GROUP) -> DataFrame:
    """``nodes``: (node, prints). Pairs (a, b), a < b, that connect what all pairs would that share an
    anchor in any half of any fingerprint and differ in at most ``threshold`` bits of the first
    ``COMPARED`` fingerprints."""
    shown = min(prints, COMPARED)
    names = ["node", *(f"p{k}" for k in range(shown))]
    schema = ", ".join(f"{c} long" for c in ["key", *names])
    flat = [F.col("node"), *(F.col("prints")[k].alias(f"p{k}") for k in range(prints))]

    def covered(batches):
        for batch in batches:
            every = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for s in range(0, len(every), 250):
                part = every[s : s + 250]
                keys = np.concatenate([anchors(part[:, 1 + k]) for k in range(prints)], axis=1)
                real = keys.ravel() >= 0
                keys = (keys | np.repeat(np.arange(prints) << 42, 32)).ravel()[real]
                # The rows of a text stand together, so that shuffle blocks compress well.
                rows = np.repeat(part[:, : 1 + shown], 32 * prints, axis=0)[real]
                columns = [pa.array(keys), *(pa.array(rows[:, j]) for j in range(rows.shape[1]))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", *names])

    first = _dealt(nodes.select(*flat).mapInArrow(handing_back(covered), schema), threshold, limit, _Rows)
    crowded = first.filter("b is null").select("key", F.col("a").alias("node"))
    blocks = crowded.groupBy("key").agg(F.ceil(F.count("*") * 2 / limit).alias("blocks"))
    own, other = F.pmod("node", "blocks"), F.col("other")
    pairs = (
        crowded.join(blocks, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("key", F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
        .join(nodes, "node")
    )
    second = _dealt(pairs.select("key", *flat[: 1 + shown]), threshold, None, _Rows)
    both = first.filter("b is not null").select("a", "b").union(second.select("a", "b"))
    # A node meets the same few others at many anchors; in a task, all its links to smaller ones.
    fewer = both.repartition("b").mapInArrow(handing_back(_forest), "a long, b long")
    return settle(fewer, "proposed")


def _links_across(rows: pa.Table, threshold: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """``rows``: (block, node, class, prints, hashes) of one block of a family, or of two, in order. Links
    that connect the same classes as all links of two classes would, in the block or from one block
    to the other: the exact test decides on pairs that are near by bits and share an anchor."""
    block, node, label = (rows.column(c).to_numpy() for c in ("block", "node", "class"))
    n, cross = len(block), int(np.searchsorted(block, block[-1]))
    prints = rows.column("prints").combine_chunks().flatten().to_numpy().reshape(n, -1)
    shown = prints[:, :COMPARED]
    hashes = rows.column("hashes").combine_chunks()
    size = pa.compute.list_value_length(hashes).to_numpy().astype(np.int64)
    names, numbers = np.unique(hashes.flatten().to_numpy(), return_inverse=True)
    start, held = np.cumsum(size) - size, np.zeros(len(names), dtype=bool)
    words = None
    a, b = [], []
    for x in range(cross or n):
        begin = cross or x + 1
        y = begin + np.flatnonzero(label[begin:] != label[x])
        y = y[_near(shown[y], shown[x], threshold)]
        if not len(y):
            continue
        own, ends = numbers[start[x] : start[x] + size[x]], np.cumsum(size[y])
        held[own] = True
        hit = np.cumsum(held[numbers[np.arange(ends[-1]) + np.repeat(start[y] - ends + size[y], size[y])]])
        held[own] = False
        shared = np.diff(np.concatenate([[0], hit])[np.concatenate([[0], ends])])
        y = y[shared >= similarity * (size[x] + size[y] - shared)]
        if len(y) and words is None:
            words = anchors(prints.ravel()).reshape(n, -1, 16)
        if len(y):
            mine = np.where(words[x] < 0, -2, words[x])
            meet = [(words[z, :, :, None] == mine[None, :, None, :]).any(axis=(1, 2, 3)) for z in np.array_split(y, -(-len(y) // 64))]
            y = y[np.concatenate(meet)]
        if len(y):
            met, at = np.unique(label[y], return_index=True)
            a.append(np.broadcast_to(node[x], at.shape))
            b.append(node[y[at]])
            label = np.where(np.isin(label, met), label[x], label)
    none = [np.empty(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


#: Texts of a family, and hashes of their sets, that make a block; a task compares two blocks.
BLOCK_TEXTS = 1_000
BLOCK_HASHES = 500_000


def links_across(nodes: DataFrame, sets: DataFrame, threshold: int, similarity: float) -> DataFrame:
    """``nodes``: (node, class, family, prints); ``sets``: (node, hashes). Links (a, b) that connect the
    classes of each family as all links of two classes in it would: texts that share an anchor in any
    half of any fingerprint, differ in at most ``threshold`` bits of the first ``COMPARED``
    fingerprints, and share at least ``similarity`` of all hashes.

    Any two blocks of a family meet in a group of their own, with their sets, and pairs are tested
    there, so that only links leave a task: fewer than it has texts."""
    marked = _few(settle(nodes.select("node", "family"), "family_of"))
    weighed = sets.select("node", F.size("hashes").alias("size")).join(marked, "node").groupBy("family")
    counted = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_HASHES))
    told = settle(nodes.join(weighed.agg(counted.alias("blocks")), "family"), "family_blocks")
    own, other = F.pmod(F.xxhash64("node"), "blocks"), F.col("other")
    met = (
        sets.join(_few(told, PICKED // 4), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("family", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), own.alias("block"), "node", "class", "prints", "hashes")
    )
    group = ["family", "low", "high"]
    dealt = met.repartition(*group).sortWithinPartitions(*group, "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []

        def linked() -> pa.RecordBatch:
            a, b = _links_across(pa.Table.from_batches(parts), threshold, similarity)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])[: len(keys)])
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if parts and tuple(keys[s]) != last:
                    yield linked()
                    parts = []
                last = tuple(keys[s])
                parts.append(batch.slice(s, e - s))
        if parts:
            yield linked()

    return settle(dealt.mapInArrow(handing_back(run), "a long, b long").distinct(), "across")


#: Most rows of numbers that are broadcast to pick rows of a larger table: 32 MB.
PICKED = 1_000_000


def _few(rows: DataFrame, most: int = PICKED) -> DataFrame:
    """Stored rows of numbers, marked for broadcast if they are few; else Spark decides."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (node, hashes) share at least ``similarity`` of all hashes.
    Only sets of nodes in pairs move."""
    pairs = settle(pairs, "pairs")
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).join(_few(pairs), "a")
    ends = _few(settle(pairs.select("b").distinct(), "ends"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")).join(ends, "b", "left_semi")
    shared = F.size(F.array_intersect("x", "y"))
    alike = shared >= similarity * (F.size("x") + F.size("y") - shared)
    return settle(left.join(right, "b").filter(alike).select("a", "b"), "verified")


def _classes(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    roots = components(links).select("node", F.col("root").alias(name))
    return settle(nodes.join(roots, "node", "left").withColumn(name, F.coalesce(name, "node")), name)


def similar_classes(
    nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], prints: int, similarity: float
) -> DataFrame:
    """``nodes``: (node, prints) of distinct sets; ``sets_of`` gives (node, hashes) of the nodes
    that a table (node) names. To (node, root), the classes of all proposed pairs whose exact
    similarity is high enough. Sets of nodes that no pair names are never made.

    A first pass proposes enough pairs to connect what bits connect, and each node is tested
    against its smallest proposed neighbour. Where that leaves a group of proposals in several classes,
    all pairs across them are tested in blocks, without being listed.
    """
    threshold = differing_bits(similarity, min(prints, COMPARED), 3)
    first = proposed(nodes.select("node", "prints"), prints, threshold)
    both = first.union(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sets = settle(sets_of(settle(both.select(F.col("a").alias("node")).distinct(), "asked")), "sets")
    least = both.groupBy("a").agg(F.min("b").alias("b"))
    least = least.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = verified(least, sets, similarity)
    group = _classes(_classes(nodes.select("node"), links, "class"), first, "family")
    split = group.groupBy("family").agg(F.min("class").alias("c"), F.max("class").alias("d"))
    left = group.join(split.filter("c <> d").select("family"), "family")
    left = settle(left.join(nodes, "node").select("node", "class", "family", "prints"), "split")
    links = links.union(links_across(left, sets, threshold, similarity))
    return _classes(nodes.select("node"), links, "root")


def differing_bits(similarity: float, prints: int, deviations: float = 1) -> int:
    """Bits of ``prints`` fingerprints that texts of this similarity (shared of all shingles)
    differ in: the angle between their counts as a share of all bits, and standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * prints
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def tuple_links(tuples: DataFrame, prints: int, threshold: int, limit: int = GROUP) -> DataFrame:
    """``tuples``: distinct texts as (node, prints). Links (a, b), a < b, of nodes that share an
    anchor in any half of any fingerprint and differ in at most ``threshold`` bits of all; they
    connect the same nodes as all such links. A crowded anchor is cut into blocks, and all pairs
    of blocks are compared, each pair in its own group."""
    names = [f"p{k}" for k in range(prints)]
    schema = ", ".join(f"{c} long" for c in ["key", *names])
    flat = [F.col("prints")[k].alias(names[k]) for k in range(prints)]

    def covered(batches):
        for batch in batches:
            every = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for s in range(0, len(every), 2_000):
                part = every[s : s + 2_000]
                keys = np.concatenate([anchors(part[:, k]) for k in range(prints)], axis=1)
                print_of = np.repeat(np.arange(prints) << 42, 32)
                real = keys.ravel() >= 0
                keys = (keys | print_of).ravel()[real]
                # The rows of a text stand together, so that shuffle blocks compress well.
                rows = np.repeat(part, 32 * prints, axis=0)[real]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), *(pa.array(rows[:, j]) for j in range(prints))],
                    names=["key", *names],
                )

    first = _dealt(tuples.select(*flat).mapInArrow(covered, schema), threshold, limit)
    crowded = first.filter("b is null").select("key", F.col("a").alias("node"))
    blocks = crowded.groupBy("key").agg(F.ceil(F.count("*") * 2 / limit).alias("blocks"))
    own, other = F.pmod("node", "blocks"), F.col("other")
    pairs = (
        crowded.join(blocks, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("key", F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
        .join(tuples, "node")
    )
    second = _dealt(pairs.select("key", *flat), threshold, None)
    both = first.filter("b is not null").select("a", "b").union(second.select("a", "b"))
    return both.distinct()


def near_classes(
    docs: DataFrame, doc_id: str = "doc_id", threshold: int = THRESHOLD, similarity: float = 0.8
) -> DataFrame:
    """``docs`` (with a column ``prints`` of fingerprints) with ``component_id``, the smallest
    id that links reach. One fingerprint links at ``threshold`` or fewer differing bits; several
    link at the differing bits of ``similarity``."""
    docs = docs.drop("component_id")
    n = docs.select(F.max(F.size("prints"))).first()[0] or 1
    key = unused(docs, "class_print")
    if n == 1:
        nodes = docs.select(F.col("prints")[0].alias("print"), F.col(doc_id).alias("id"))
        nodes = settle(nodes.groupBy("print").agg(F.min("id").alias("id")), "prints")
        roots = components(near_links(nodes.select("print"), threshold))
        joined = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
            "print", "id", F.coalesce("root", "print").alias("root")
        )
        joined = settle(joined, "roots")
        least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
        table = settle(joined.select("print", "root").join(least, "root"), "classes")
        print_ = F.col("prints")[0]
        out = docs.join(table.select(F.col("print").alias(key), "component_id"), print_ == F.col(key))
        return out.drop(key)

    @F.pandas_udf("long")
    def node(prints: pd.Series) -> pd.Series:
        rows = np.stack(prints.to_list()) if len(prints) else np.empty((0, n), np.int64)
        return pd.Series(node_of(rows))

    named = docs.select("prints", F.col(doc_id).alias("id")).groupBy("prints").agg(F.min("id").alias("id"))
    tuples = settle(named.withColumn("node", node("prints")), "prints")
    links = tuple_links(tuples.select("node", "prints"), n, differing_bits(similarity, n))
    joined = settle(tuples.join(components(links), "node", "left"), "roots")
    joined = joined.withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    table = joined.select(F.col("prints").alias(key), "root").join(least, "root").drop("root")
    return docs.join(settle(table, "classes"), F.col("prints") == F.col(key)).drop(key)


def one_of_each(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = 5,
    prints: int = 1,
    threshold: int = THRESHOLD,
    similarity: float = 0.8,
) -> DataFrame:
    """One document of each class: the smallest id, of equal ids one row. One
    fingerprint links at ``threshold`` or fewer differing bits; several propose pairs, and the
    exact similarity of the sets of windows decides."""
    if prints > 1:
        return _one_of_each_similar(docs, text, doc_id, size, prints, similarity)
    row = unused(docs, "row")
    named = docs.withColumn(row, F.monotonically_increasing_id())
    held = unused(named, "print_list")
    stored = settle(named.withColumn(held, fingerprints(F.col(text), size, prints)), "simhash")
    thin = stored.select(
        F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("i"), row).alias("id"),
        F.col(held).alias("prints"),
    )
    first = near_classes(thin, "id", threshold, similarity).select("component_id").distinct()
    first = settle(first.select(F.col("component_id")[row].alias(row)), "first")
    return stored.join(first, row, "left_semi").select(*docs.columns)


def _one_of_each_similar(docs, text, doc_id, size, prints, similarity) -> DataFrame:
    """Texts stay in ``docs``: a row is known by its id and two hashes of its text, and only the
    shingles of texts in a proposed pair are stored."""
    ident = {
        unused(docs, "ident_id"): F.col(doc_id),
        unused(docs, "ident_x"): F.xxhash64(text),
        unused(docs, "ident_y"): F.xxhash64(F.lit(7), F.col(text)),
    }
    keys = list(ident)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [shingle_hashes(t, size) for t in part.column(0).to_pylist()]
                node = [xxhash.xxh64_intdigest(np.unique(h).tobytes(), SEED) - (1 << 63) for h in found]
                made = [pa.array(node, pa.int64()), pa.array([majorities(h, prints) for h in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*keys, *names])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in part.column(1).to_pylist()]
                sets = pa.array(found, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["node", "hashes"])

    names = [unused(docs.select(*[c.alias(k) for k, c in ident.items()]), c) for c in ("node", "prints")]
    plain = docs.select(F.col(text), *[c.alias(k) for k, c in ident.items()])
    kinds = [*plain.schema.fields[1:], StructField(names[0], LongType()), StructField(names[1], ArrayType(LongType()))]
    told = plain.mapInArrow(handing_back(described), StructType(kinds))
    id_ = F.struct(F.col(keys[0]).isNull().alias("n"), *keys).alias("id")
    told = settle(told.select(id_, F.col(names[0]).alias("node"), F.col(names[1]).alias("prints")), "described")
    least = told.groupBy("node").agg(F.min("id").alias("id"), F.min_by("prints", "id").alias("prints"))
    least = settle(least, "least")
    own = [F.col("id")[k].alias(f"own_{k}") for k in keys]

    def same(rows: DataFrame, marks: DataFrame):
        tests = [c.eqNullSafe(marks[f"own_{k}"]) for k, c in ident.items()]
        return reduce(lambda x, y: x & y, tests)

    def sets_of(asked: DataFrame) -> DataFrame:
        wanted = _few(settle(least.join(asked, "node", "left_semi").select("node", *own), "wanted"))
        node = unused(docs, "node")
        found = docs.join(wanted.withColumnRenamed("node", node), same(docs, wanted))
        one = found.select(F.col(node).alias("node"), F.col(text).alias("text")).dropDuplicates(["node"])
        return one.mapInArrow(handing_back(shingles), "node long, hashes array<long>")

    classes = similar_classes(least.select("node", "prints"), sets_of, prints, similarity)
    first = classes.join(least.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("id"))
    counts = told.groupBy("id").agg(F.count("*").alias("times"))
    marks = settle(first.join(counts, "id").select(*own, "times"), "first")
    once = marks.filter("times = 1")
    kept = docs.join(once, same(docs, once), "left_semi")
    again = marks.filter("times > 1")  # equal rows, or rows that differ in other columns only
    rank = unused(docs, "rank")
    others = [f.name for f in docs.schema.fields if not f.dataType.typeName() in ("map", "variant")]
    rows = docs.join(again, same(docs, again), "left_semi").withColumns(ident)
    order = Window.partitionBy(*keys).orderBy(*others)
    rest = rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)
    return kept.unionByName(rest)
