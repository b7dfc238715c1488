"""Unions, differences and first-row-wins de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedupe_first(df: DataFrame, key: str | Column, *order: str | Column) -> DataFrame:
    """The first row of every key in the given order.

    The rank filter is applied before the shuffle too, so a key that holds a large part of
    the table sends at most one row per task.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
