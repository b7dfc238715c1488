"""Text to vectors, and the table that keeps them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperlode.functions.text import bind, counted, terms
from paperlode.functions.vectors import l2_normalize
from paperlode.operators.joins import new_rows
from paperlode.operators.sets import dedupe_first
from paperlode.session import path_exists, settle
from paperlode.sources.sinks import BUCKET, bucketed, in_buckets_of, stored_digits, write_buckets

BatchFn = Callable[[np.ndarray], np.ndarray]


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Unit vector of term counts hashed into ``dim`` slots (feature hashing, Weinberger et al.
    2009). Needs no model and stays in built-in expressions.

    Every slot number is added once to the hashed terms, so counting the sorted array yields
    all slots in order, each one too high.
    """
    slots = F.transform(
        terms(text),
        lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("int") % dim),
    )
    padded = F.concat(slots, F.sequence(F.lit(0), F.lit(dim - 1)))
    counts = F.transform(counted(padded), lambda c: (c["tf"] - F.lit(1)).cast("double"))
    return bind(counts, l2_normalize).cast("array<float>")


def embed(
    df: DataFrame,
    text: str,
    make_fn: Callable[[], BatchFn] | None = None,
    batch_size: int = 256,
    dim: int = 64,
    out: str = "embedding",
) -> DataFrame:
    """Adds a vector per text. ``make_fn`` is called once per Python worker (to load a model)
    and returns a function from a batch of texts to a matrix; without it texts are hashed."""
    if make_fn is None:
        return df.withColumn(out, hashed_vector(F.col(text), dim))
    predict = predict_batch_udf(
        make_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return df.withColumn(out, predict(F.coalesce(F.col(text), F.lit(""))))


def embed_missing(
    df: DataFrame, stored: DataFrame, key: str, text: str, **options
) -> DataFrame:
    """Vectors (key, ``embedding``) for the rows that have none yet."""
    fresh = new_rows(df.select(key, text), stored, key)
    return embed(fresh, text, **options).select(key, "embedding")


def index_update(
    df: DataFrame,
    path: str,
    key: str,
    text: str,
    order: str | Sequence[str] | None = None,
    digits: int = 0,
    **options,
) -> None:
    """Add vectors for ids the table at ``path`` does not hold; every row is covered. Of rows
    with the same id the first in ``order`` counts, then the one with the least text. ``digits`` lays a
    new table out in folders, as ``append_new`` does, so that only those of the load's ids are read."""
    spark = df.sparkSession
    first = [order] if isinstance(order, str) else list(order or [])
    papers = df.select(key, text, *[c for c in first if c not in (key, text)])
    papers = dedupe_first(papers, key, *first, text).select(key, text)
    stored = spark.read.parquet(path) if path_exists(spark, path) else None
    digits = digits if stored is None else stored_digits(stored)
    if not digits:
        if stored is not None:
            added = embed_missing(settle(papers, "load"), stored, key, text, **options)
        else:
            added = embed(papers, text, **options).select(key, "embedding")
        added.write.mode("append").parquet(path)
        return
    fresh = settle(bucketed(papers, key, digits), "load")
    if stored is not None:
        fresh = new_rows(fresh, in_buckets_of(stored, fresh), key)
    write_buckets(embed(fresh, text, **options).select(key, "embedding", BUCKET), path)
