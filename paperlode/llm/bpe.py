"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of symbols. A bucket for each merge rank holds the list places whose
pair has that rank; a bitmap of two levels marks the ranks whose buckets hold something, and
find-first-set gives the next rank. A place whose pair has changed meanwhile is skipped when it is
taken out. Each merge costs a constant number of bitmap steps, also in very long pre-tokens.

Null texts are empty: no ids, and no bytes after decoding. Texts may be of any length. Repeated
rows are encoded alike. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from paperlode.llm.common import hand_back, handing_back

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens of each of two generations whose ids a Python worker remembers, and the longest of
#: them in characters.
REMEMBERED = 250_000
LONGEST = 48
#: White space as the tokenizer's own regular expressions have it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pattern(source: str = public_tokenizers.PATTERN) -> regex.Pattern:
    inside = source.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(inside.replace(r"\s", f"[{WHITE}]"))


#: The same pattern where a text is ASCII, for the faster of the two regular expression modules.
PLAIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Encoder(dict):
    """Pre-token to its ids (little-endian, 32 bits each); remembers short pre-tokens."""

    def __init__(self, path: str, remembered: int | None = None):
        super().__init__()
        self.remembered = remembered or REMEMBERED
        self.ranks = read_ranks(path)
        self.old: dict[str, bytes] = {}
        self.find = pattern().findall
        # Bitmap words of 256 ranks, below one word that marks those which are not empty.
        self.leaves = [0] * ((max(self.ranks.values()) >> 8) + 1)
        self.bit = [1 << k for k in range(max(256, len(self.leaves)))]
        self.buckets: dict[int, list[int]] = {}
        # What two tokens give, by both of their ids in one number.
        self.width, get = max(self.ranks.values()).bit_length(), self.ranks.get
        self.joined: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    self.joined[a << self.width | b] = rank
        self.single = [get(bytes((x,)), -1) for x in range(256)]
        self.pairs = [self.ranks.get(bytes((x >> 8, x & 255)), -1) for x in range(1 << 16)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        find = PLAIN.findall if text.isascii() else self.find
        return b"".join(map(self.__getitem__, find(text)))

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = self.packed(word)
        if len(word) <= LONGEST:
            if len(self) >= self.remembered:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def packed(self, word: str) -> bytes:
        body = word.encode()
        whole = self.ranks.get(body)
        ids = [whole] if whole is not None else self.merge(body)
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge(self, body: bytes) -> list[int]:
        leaves, buckets, bit = self.leaves, self.buckets, self.bit
        get, width = self.joined.get, self.width
        n, top = len(body), 0
        ids = list(map(self.single.__getitem__, body))  # the symbol that starts at a place
        end = list(range(1, n + 1))  # where the symbol that starts at a place ends
        before = list(range(-1, n - 1))  # the start of the symbol before it
        pairs = self.pairs
        now = [pairs[a << 8 | b] for a, b in zip(body, body[1:], strict=False)]
        now.append(-1)  # rank of the pair that starts at a place
        for i, rank in enumerate(now):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    leaves[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
        while top:
            block = (top & -top).bit_length() - 1
            leaf = leaves[block]
            low = leaf & -leaf
            rank = block << 8 | (low.bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                leaves[block] = leaf = leaf ^ low
                if not leaf:
                    top &= top - 1
            if now[i] != rank:
                continue
            j = end[i]
            end[i] = k = end[j]
            ids[i] = rank
            now[j] = -1
            if k < n:
                before[k] = i
                now[i] = new = get(rank << width | ids[k], -1)
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        leaves[new >> 8] |= bit[new & 255]
                        top |= bit[new >> 8]
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = new = get(ids[h] << width | rank, -1)
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], h)
                    else:
                        buckets[new] = [h]
                        leaves[new >> 8] |= bit[new & 255]
                        top |= bit[new >> 8]
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return out


@lru_cache(maxsize=1)
def encoder(path: str, remembered: int | None = None) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, remembered)


@lru_cache(maxsize=2)
def tokens(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode(
    docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", remembered: int | None = None
) -> DataFrame:
    """``docs`` without the text and with ``ids``: little-endian, unsigned, 32 bits each.

    ``path`` names the rank file on every machine. ``remembered``: pre-tokens of a generation, where
    a worker has less memory than ``REMEMBERED`` of them need; the ids are the same.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kept = [f for f in docs.schema.fields if f.name not in (text, ids)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = encoder(path, remembered)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                body = part.column(part.schema.get_field_index(text))
                made = pa.array([ready.encode(t) for t in body.to_pylist()], pa.binary())
                columns = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, made], names=[*names, ids])

    schema = StructType([*kept, StructField(ids, BinaryType())])
    return docs.select(*names, text).mapInArrow(handing_back(run), schema)


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes that packed ids stand for."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("binary")
    def udf(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = tokens(path)
        for batch in packed:
            parts = []
            for s in range(0, len(batch), 512):
                found = (x.as_buffer() for x in batch.slice(s, 512))
                parts.append(pa.array([b"".join(map(table.__getitem__, memoryview(x).cast("I"))) for x in found], pa.binary()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
            del parts
            hand_back()

    return udf(ids)
