"""Incremental loads from a folder of arriving files.

The target table is the only memory: a batch keeps the first row per key and drops keys the
table already holds, so running a batch again after a failure adds nothing twice. With ``digits`` the
table is laid out in folders by a hash of the key, and a batch reads only those of its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from paperlode.operators.embedding import index_update
from paperlode.sources.sinks import append_new


def _arriving(spark: SparkSession, src: str, schema: T.StructType | str, fmt: str, files: int) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(src)


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest(
    spark: SparkSession,
    src: str,
    table: str,
    key: str,
    schema: T.StructType | str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    order: str | Sequence[str] | None = None,
    fmt: str = "json",
    files: int = 1000,
    digits: int = 0,
) -> StreamingQuery:
    """Prepare, de-duplicate and append every file that has arrived since the last run. Of rows
    with the same key in one batch the first in ``order`` is kept."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(prepare(batch), table, key, order, digits)

    return _run(_arriving(spark, src, schema, fmt, files), write, checkpoint)


def ingest_embeddings(
    spark: SparkSession,
    src: str,
    table: str,
    key: str,
    text: str,
    schema: T.StructType | str,
    checkpoint: str,
    order: str | Sequence[str] | None = None,
    fmt: str = "parquet",
    files: int = 1000,
    **options,
) -> StreamingQuery:
    """Add vectors for papers that have arrived since the last run and have none yet."""

    def write(batch: DataFrame, _: int) -> None:
        index_update(batch, table, key, text, order, **options)

    return _run(_arriving(spark, src, schema, fmt, files), write, checkpoint)
