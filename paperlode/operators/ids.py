"""Surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlode.operators.joins import new_rows
from paperlode.session import settle

# Hex digits of the key hash that ids are ordered by first.
HASH_DIGITS = 3


def with_uuid(df: DataFrame, key: str | None = None, name: str = "uuid") -> DataFrame:
    """A text id per row: random, or a hash of ``key`` when one is given.

    A random id changes whenever the plan is evaluated again, so write the table once and
    read ids from there.
    """
    return df.withColumn(name, F.sha2(F.col(key).cast("string"), 256) if key else F.uuid())


def number_by(df: DataFrame, *order: Column, start: int | Column = 0, name: str = "int_id") -> DataFrame:
    """The rows with their place in the given order, from ``start``.

    Sampled splitters deal the rows out by range, each written partition keeps its rows in order,
    and only one count for each partition is summed up: nothing is counted row by row over the
    whole table, and what is broadcast has as many rows as there are partitions. The rows are
    settled first, so counts and numbers come from the same rows.
    """
    keys = {f"_order{i}": column for i, column in enumerate(order)}
    ranged = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = settle(ranged.drop(*keys).withColumn("_at", F.monotonically_increasing_id()), "keys")
    part, inside = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy(part).agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    base = start if isinstance(start, Column) else F.lit(start)
    return (
        laid.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (base + F.col("_offset") + inside).cast("bigint"))
        .drop("_part", "_at", "_offset")
    )


def number_rows(df: DataFrame, key: str, start: int | Column = 0, name: str = "int_id") -> DataFrame:
    """Numbers the distinct keys of ``df`` densely from ``start``, by a hash of the key, then the
    key: neighbours in the key are spread over all ids, and splitters stay even."""
    hashed = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, HASH_DIGITS)
    return number_by(df, hashed, F.col(key), start=start, name=name)


def dense_ids(df: DataFrame, key: str, id_map: DataFrame | None = None) -> DataFrame:
    """The id map (``key``, ``int_id``) extended by the keys of ``df`` it lacks, which get the
    numbers after its current maximum. Running it again adds nothing."""
    keys = df.select(key).distinct()
    if id_map is None:
        return number_rows(keys, key)
    start = F.coalesce(id_map.select(F.max("int_id") + 1).scalar(), F.lit(0))
    added = number_rows(new_rows(keys, id_map, key), key, start)
    return id_map.select(key, "int_id").unionByName(added)


def joint_ids(queries: DataFrame, query_key: str, docs: DataFrame, doc_key: str) -> DataFrame:
    """One integer id space, queries first: ``side``, ``key``, ``int_id``."""
    query_keys = queries.select(F.col(query_key).cast("string").alias("key")).distinct()
    doc_keys = docs.select(F.col(doc_key).cast("string").alias("key")).distinct()
    start = query_keys.select(F.count("*")).scalar()
    return (
        number_rows(query_keys, "key")
        .select(F.lit("query").alias("side"), "key", "int_id")
        .unionByName(
            number_rows(doc_keys, "key", start).select(F.lit("doc").alias("side"), "key", "int_id")
        )
    )
