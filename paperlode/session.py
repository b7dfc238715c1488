"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "paperlode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; extra settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, ``spark.paperlode.scratch.dir`` (which a running session can set)
    names the folder, and else a folder in the warehouse, which all executors share too.
    What is written there is removed when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.paperlode.scratch.dir", None
    )
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    for made in _WATCHERS:
        made.append(path)
    return path


_WATCHERS: list[list[str]] = []


@contextmanager
def scratch_made() -> Iterator[list[str]]:
    """The scratch paths that are named inside, for ``drop_scratch`` once nothing reads them."""
    made: list[str] = []
    _WATCHERS.append(made)
    try:
        yield made
    finally:
        _WATCHERS[:] = [w for w in _WATCHERS if w is not made]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan is cut and every
    reader sees the same rows, also after executors are lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the file system that owns ``path``."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)
