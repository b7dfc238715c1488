"""Stored tables, SQL over views, and the retrieval collection."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, types as T

from paperlode import schemas


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema; blank lines give no rows."""
    return spark.read.schema(schema).json(path)


def read_jsonl_tree(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """Every ``.json`` file below ``root`` as one table; empty files give no rows."""
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(root)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a plain scan that has fewer splits than the cluster has cores.

    For work that is heavy per row (tokenising whole texts) over a few large row groups. A
    table with at least one split per core, so any large one, is passed through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def run_sql(
    spark: SparkSession,
    sql: str,
    views: Mapping[str, DataFrame],
    args: Mapping[str, object] | None = None,
) -> DataFrame:
    """A SQL string over named tables, with named parameters."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(args or {}))


class Collection(NamedTuple):
    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame


def read_ir_collection(spark: SparkSession, root: str) -> Collection:
    """``documents``, ``queries`` and ``qrels`` JSON-lines folders below ``root``."""
    return Collection(
        read_jsonl(spark, f"{root}/documents", schemas.IR_DOCUMENTS),
        read_jsonl(spark, f"{root}/queries", schemas.IR_QUERIES),
        read_jsonl(spark, f"{root}/qrels", schemas.IR_QRELS),
    )
