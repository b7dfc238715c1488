"""Text inventories and LaTeX source trees as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlode.functions.resources import last_wins


RECORD = "file STRING, split BIGINT, place BIGINT, value STRING"


def _after_marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (value, file, split) of whole splits in order, to records with their place in the
    split. The first piece of a file is what stands before its first marker."""
    last, place = None, 0
    for batch in batches:
        values, files, splits = (c.to_pylist() for c in batch.columns)
        kept, places = [], []
        for i, at in enumerate(zip(files, splits, strict=True)):
            place = place + 1 if at == last else 0
            last = at
            if place or splits[i]:
                kept.append(i)
                places.append(place)
        value, file, split = (c.take(pa.array(kept, pa.int64())) for c in batch.columns)
        yield pa.RecordBatch.from_arrays(
            [file, split, pa.array(places, pa.int64()), value], names=["file", "split", "place", "value"]
        )


def read_kv_records(spark: SparkSession, path: str, marker: str = "NodeName=") -> DataFrame:
    """One row per record opened by ``marker``: its ``key=value`` pairs as a map.

    The scan splits on the marker, so files need not fit a task, and it is made once. A record is
    known by its file, the byte where its split starts and its place there; the first piece of
    the split at byte 0 stands before the file's first marker and is left out.
    """
    pieces = (
        spark.read.option("lineSep", marker)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
        )
    )
    records = pieces.mapInArrow(_after_marker, RECORD)
    text = F.concat(F.lit(marker), F.replace("value", F.lit("\n"), F.lit(" ")))
    items = F.regexp_extract_all(text, F.lit(r"\S+?=\S+"), F.lit(0))
    pairs = F.transform(
        items,
        lambda item: F.struct(
            F.substring_index(item, "=", 1).alias("key"),
            F.substring(item, F.instr(item, "=") + F.lit(1), F.length(item)).alias("value"),
        ),
    )
    return records.select("file", "split", "place", last_wins(pairs).alias("fields"))


def read_tex_files(spark: SparkSession, root: str, glob: str = "*.tex") -> DataFrame:
    """Every ``.tex`` file below ``root/<paper_id>/``: ``paper_id``, ``path``, ``text``. The
    folder may also be written ``paper_id=<paper_id>``.

    Bytes that are not UTF-8 are left out and unreadable files are skipped.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", True)
        .load(root)
    )
    base = F.lit(root.rstrip("/").split("://")[-1].replace("file:", "") + "/")
    below = F.substring(F.col("path"), F.instr(F.col("path"), base) + F.length(base), F.length("path"))
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(
        F.regexp_replace(F.substring_index(below, "/", 1), "^paper_id=", "").alias("paper_id"),
        "path",
        F.replace(valid, F.lit("�"), F.lit("")).alias("text"),
    )
