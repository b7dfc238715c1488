"""URL filters by cascades of Bloom filters.

Every URL asks for the same few keys: each suffix of its host at a label, of no more labels than a
rule's host, with each start of its path that is as long as some rule's path. All such keys of the corpus are the universe. A cascade
holds a list of keys: level 1 encodes the listed keys, level 2 the other keys of the universe that
level 1 lets through, level 3 the listed keys that level 2 lets through, and so on until nothing
is let through. The first level that says no then decides, exactly for every key of the universe,
and judging needs no join. One cascade holds all rules, a second one those that block.

Sizes: a level has ``BITS`` bits for each key that it holds, except the first, which has enough
to let about as many other keys through as there are listed ones. All levels together grow with
the rule list (times the logarithm of the universe), not with the corpus; rules are a list given
by the user.

A null URL, or one without ``://``, has an empty host and path, meets no rule and is allowed.
Repeated rows are judged alike. An empty table gives an empty table. Columns of the input that
have the name of a result are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import let, unused
from paperlode.session import settle

BITS = 12.0
HASHES = 7
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#``; A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int], most: int) -> Column:
    """The keys that may name a rule for a URL, longest first; a rule's host has at most ``most``
    labels, and longer suffixes of a host are no rule."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - F.lit(most - 1))

    def suffix(i: Column) -> Column:
        return F.array_join(F.slice(labels, i, F.size(labels)), ".")

    def keys(i: Column) -> Column:
        starts = [
            F.when(F.length(path) >= n, F.concat(suffix(i), F.substring(path, 1, n)))
            for n in lengths
        ]
        return F.array_compact(F.array(*starts))

    found = F.flatten(F.transform(F.sequence(first, F.size(labels)), keys))
    ranked = F.sort_array(
        F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))), asc=False
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(ranked, lambda x: x["k"])
    )


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Places in the filter of ``level``, one row for each hash function."""
    with np.errstate(over="ignore"):
        mixed = h1.astype(np.uint64) ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        step = h2.astype(np.uint64) | np.uint64(1)
        out = np.empty((HASHES, len(mixed)), dtype=np.int64)
        for k in range(HASHES):
            x = mixed + np.uint64(k) * step
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            out[k] = (x % np.uint64(bits)).astype(np.int64)
    return out


class Cascade:
    """The levels as byte arrays of bits; ``member`` is exact for the keys of the universe."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        state = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h1))
        for level, (bits, packed) in enumerate(self.levels):
            if not len(open_):
                break
            inside = _inside(h1[open_], h2[open_], level, bits, packed)
            state[open_[~inside]] = level % 2 == 1
            open_ = open_[inside]
        return state


def _inside(h1, h2, level: int, bits: int, packed: np.ndarray) -> np.ndarray:
    at = _places(h1, h2, level, bits)
    return ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _bits(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """The filter of one level: places found in tasks, distinct bytes added up, bytes sent."""

    def places(batches):
        for b in batches:
            at = _places(b["h1"].to_numpy(), b["h2"].to_numpy(), level, bits).ravel()
            yield pd.DataFrame({"byte": at >> 3, "bit": (1 << (at & 7)).astype(np.int32)})

    found = keys.select("h1", "h2").mapInPandas(places, "byte long, bit int")
    packed = np.zeros((bits + 7) // 8, dtype=np.uint8)
    for row in found.groupBy("byte").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        packed[row["byte"]] = row["bit"]
    return packed


def build_cascade(universe: DataFrame) -> Cascade:
    """``universe``: distinct keys as (h1, h2, listed). Each level stores what it lets through,
    which shrinks by the filter's error rate, so levels end after a few."""
    listed = universe.filter("listed")
    other = universe.filter("not listed")
    n_listed, n_other = listed.count(), other.count()
    levels: list[tuple[int, np.ndarray]] = []
    if not n_listed:
        return Cascade(levels)
    want = max(1.0, math.log2(max(2.0, n_other / n_listed))) / math.log(2) + 4
    inside, against, n = listed, other, n_listed
    while n:
        if len(levels) >= MAX_LEVELS:
            raise ValueError("two keys of the universe have equal hashes")
        bits = max(64, math.ceil(n * (want if not levels else BITS)))
        level, packed = len(levels), _bits(inside, len(levels), bits)
        levels.append((bits, packed))

        def passed(batches, level=level, bits=bits, packed=packed):
            for b in batches:
                yield b[_inside(b["h1"].to_numpy(), b["h2"].to_numpy(), level, bits, packed)]

        through = settle(against.mapInPandas(passed, against.schema), "cascade")
        inside, against, n = through, inside, through.count()
    return Cascade(levels)


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (``allow`` or ``block``, host + path). A rule fits its host and all subdomains
    where the path starts with the rule's; the longest one decides, ``default`` if none fits.
    """
    actions = {key: action for action, key in rules}
    lengths = sorted({len(key) - key.index("/") for key in actions})
    labels = max((key[: key.index("/")].count(".") + 1 for key in actions), default=1)
    named = ("host", "path", "rule", "verdict")
    pages = pages.drop(*named)
    parts = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))

    spark = pages.sparkSession
    keys = parts.select("host", "path").select(
        F.explode(candidate_keys(F.col("host"), F.col("path"), lengths, labels)).alias("key")
    )
    table = spark.createDataFrame([(k, a == "block") for k, a in actions.items()], "key string, block boolean")
    hashes = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")]
    universe = settle(keys.distinct().select("key", *hashes), "universe")
    universe = universe.join(table, "key", "left")
    all_rules = universe.select("h1", "h2", F.col("block").isNotNull().alias("listed"))
    blocking = universe.filter("block is not null").select("h1", "h2", F.col("block").alias("listed"))
    listed, blocked = build_cascade(all_rules), build_cascade(blocking)

    @F.pandas_udf("array<byte>")
    def look_up(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """For each key of a URL: 0 no rule, 1 allow, 2 block."""
        sizes = h1.map(len).to_numpy()
        a = np.concatenate([np.asarray(x, dtype=np.int64) for x in h1] or [np.empty(0, np.int64)])
        b = np.concatenate([np.asarray(x, dtype=np.int64) for x in h2] or [np.empty(0, np.int64)])
        known = listed.member(a, b)
        found = known.astype(np.int8)
        found[known] += blocked.member(a[known], b[known])
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1])) if len(sizes) else pd.Series([])

    keys_, found_, hit_ = (unused(parts, c) for c in ("keys", "found", "hit"))
    asked = parts.withColumn(keys_, candidate_keys(F.col("host"), F.col("path"), lengths, labels))
    asked = asked.withColumn(
        found_,
        look_up(
            F.transform(keys_, lambda k: F.xxhash64(k)),
            F.transform(keys_, lambda k: F.xxhash64(F.lit(1), k)),
        ),
    )
    hit = let(
        F.filter(F.arrays_zip(keys_, found_), lambda x: x[found_] > 0),
        lambda h: F.struct(
            F.get(h, F.lit(0))[keys_].alias("rule"), F.get(h, F.lit(0))[found_].alias("found")
        ),
    )
    verdict = F.when(F.col(f"{hit_}.found") == 2, "block").when(F.col(f"{hit_}.found") == 1, "allow")
    return (
        asked.withColumn(hit_, hit)
        .withColumn("rule", F.col(f"{hit_}.rule"))
        .withColumn("verdict", verdict.otherwise(default))
        .drop(keys_, found_, hit_)
    )
