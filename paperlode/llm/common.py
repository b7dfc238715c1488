"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.memory import hand_back, handing_back  # noqa: F401
from paperlode.session import settle

#: Words are runs of characters other than blank, tab, line feed, VT, FF and CR.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once for each row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """All words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def unused(df: DataFrame, name: str) -> str:
    """A column name starting with ``name`` that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[Column], number: str = "number") -> tuple[DataFrame, int]:
    """The rows with their place (from 0) in the given order, and how many there are.

    A range sort deals the rows out, each written partition counts its own, and only one row
    for each partition is summed up. A unique last sort key splits rows that are equal in the
    order, so that no partition grows with the copies of a row.
    """
    spark, tie, at = df.sparkSession, unused(df, "tie"), unused(df, "at")
    ordered = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*order, tie)
    laid = settle(ordered.drop(tie).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(at), 33)
    own, begin = unused(laid, "part"), unused(laid, "start")
    ends = laid.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()
    start, starts = 0, {}
    for part_id, rows in sorted((e["part"], e["rows"]) for e in ends):
        starts[part_id] = start
        start += rows
    if not starts:
        return laid.withColumn(number, F.lit(0).cast("long")).drop(at), 0
    # An Arrow table needs no Python workers on the executors, where a list does.
    table = pa.table({own: pa.array(list(starts), pa.int64()), begin: pa.array(list(starts.values()), pa.int64())})
    offsets = F.broadcast(spark.createDataFrame(table))
    local = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    out = laid.join(offsets, part == F.col(own)).withColumn(number, F.col(begin) + local)
    return out.drop(at, own, begin), start
