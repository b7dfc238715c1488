"""Writers: JSON lines, parquet tables, append of new rows, snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlode.operators.joins import new_rows
from paperlode.operators.sets import dedupe_first
from paperlode.session import path_exists, settle


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


# Folder column of a bucketed table: the first hex digits of a hash of the key.
BUCKET = "_bucket"


def bucketed(df: DataFrame, key: str, digits: int) -> DataFrame:
    """``df`` with the folder that a row belongs to."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.withColumn(BUCKET, F.concat(F.lit("b"), F.substring(F.md5(text.cast("binary")), 1, digits)))


def stored_digits(stored: DataFrame) -> int:
    """How many digits a stored table's folders have; 0 for a table without folders."""
    row = stored.select(BUCKET).first() if BUCKET in stored.columns else None
    return len(row[0]) - 1 if row else 0


def write_buckets(df: DataFrame, path: str) -> None:
    """Append rows to their folders. Rebalancing brings a folder's rows together and splits a
    crowded one."""
    df.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``append_new`` keeps."""
    return spark.read.parquet(path).drop(BUCKET)


def in_buckets_of(stored: DataFrame, load: DataFrame) -> DataFrame:
    """The stored rows in folders that a load's keys belong to; other folders are not read. There
    are 16 to the number of digits folders at most, so the list of them is short."""
    folders = sorted(r[0] for r in load.select(BUCKET).distinct().collect())
    return stored.filter(F.col(BUCKET).isin(folders))


def append_new(
    df: DataFrame, path: str, key: str, order: str | Sequence[str] | None = None, digits: int = 0
) -> None:
    """Append the rows whose key the table at ``path`` does not hold yet, one per key.

    Of rows with the same key the first in ``order`` counts; rows that are equal there, or all
    without an order, go by their other columns, so a load gives the same rows however it is
    dealt out. With ``digits`` a new table is laid out in folders by that many hex digits of a hash
    of the key: a load is compared with the folders of its own keys only, and a crowded folder is
    split over files. ``read_bucketed`` reads such a table. A table that was stored without folders
    stays so, and the keys of all of it are gone through.

    Running it again with the same rows changes nothing. One writer at a time. The load is
    settled first: it is compared with the table and written from the same rows, and its size
    on disk lets Spark decide whether its keys are small enough to broadcast.
    """
    spark = df.sparkSession
    first = [order] if isinstance(order, str) else list(order or [])
    sortable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    ranked = dedupe_first(df, key, *first, *[c for c in sortable if c not in first])
    stored = spark.read.parquet(path) if path_exists(spark, path) else None
    digits = digits if stored is None else stored_digits(stored)
    if not digits:
        fresh = settle(ranked, "load")
        fresh = fresh if stored is None else new_rows(fresh, stored, key)
        fresh.write.mode("append").parquet(path)
        return
    fresh = settle(bucketed(ranked, key, digits), "load")
    if stored is not None:
        fresh = new_rows(fresh, in_buckets_of(stored, fresh), key)
    write_buckets(fresh, path)


def replace_table(df: DataFrame, name: str) -> None:
    """Replace a catalog table. ``df`` must not read the table itself."""
    df.write.mode("overwrite").saveAsTable(name)


def write_snapshot(df: DataFrame, root: str, now: datetime) -> str:
    """JSON lines under a time-stamped name; returns the path."""
    path = f"{root.rstrip('/')}/{now:%Y-%m-%d-%H-%M-%S}.json"
    write_jsonl(df, path)
    return path


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The finished table at ``path``, building and storing it first when it is not there."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
