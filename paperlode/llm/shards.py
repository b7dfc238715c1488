"""Reproducible shuffle into shards by a Feistel permutation, with built-in functions only.

Rows are numbered globally; a keyed Feistel network over a square just above the number of rows,
with cycle walking, maps the number to a place; the place gives shard and slot. A shard's rows
can therefore be computed from the number of rows, the seed and the row number alone.

Null text has no bytes. Rows equal in key and text keep their own numbers and places. Null keys
come first. An empty table gives an empty table. Any number of shards, also more than rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import let, numbered, unused

ROUNDS = 6
#: Up to 400 rows, at most this many numbers lie outside; above, a walk as long as this one has
#: a chance below 1e-30, and ``permuted`` fails rather than give a number twice.
WALK = 40


def permuted(number: Column, rows: int, seed: int = 0) -> Column:
    """A permutation of 0 .. rows - 1.

    Numbers are pairs of digits of a square of ``side`` times ``side`` fields; a round adds a
    hash of one digit to the other. Fields beyond the last row are walked on from.
    """
    side = max(1, math.isqrt(max(rows - 1, 0)) + 1)

    def round_(k: int):
        def step(p: Column) -> Column:
            added = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), p["b"]), F.lit(side))
            return F.struct(p["b"].alias("a"), F.pmod(p["a"] + added, F.lit(side)).alias("b"))

        return step  # one parameter: a second one would be the place in the array

    def network(x: Column) -> Column:
        pair = F.struct((x / side).cast("long").alias("a"), (x % side).alias("b"))
        for k in range(ROUNDS):
            pair = let(pair, round_(k))
        return let(pair, lambda p: p["a"] * side + p["b"])

    def walk(x: Column) -> Column:
        end = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)),
            x,
            lambda at, _: F.when(at < rows, at).otherwise(network(at)),
        )
        error = F.raise_error(F.lit("cycle walk too long")).cast("long")
        return F.when(x < rows, x).otherwise(let(end, lambda e: F.when(e < rows, e).otherwise(error)))

    return let(network(number.cast("long")), walk)


def shard_rows(
    docs: DataFrame, order: list[Column], n_shards: int = 24, seed: int = 0
) -> DataFrame:
    """The rows with ``number``, ``shard`` and ``slot``, which replace columns of these names: row
    counts differ by one at most and slots have no gaps. ``order`` numbers the rows, so reruns
    agree if it tells rows apart."""
    rows, count = numbered(docs.drop("number", "shard", "slot"), order)
    place = unused(rows, "place")
    at = F.inline(F.array(F.struct(permuted(F.col("number"), count, seed).alias(place))))
    return (
        rows.select("*", at)
        .withColumn("shard", (F.col(place) % n_shards).cast("int"))
        .withColumn("slot", (F.col(place) / n_shards).cast("long"))
        .drop(place)
    )
