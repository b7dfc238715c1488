"""Whole-table projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from paperlode.functions.text import category_tokens
from paperlode.schemas import FLAG_CATEGORIES, flag_name


def select_cols(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])


def drop_cols(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def rename_cols(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def add_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def ensure_text_cols(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, added as empty text where the table lacks them."""
    return add_constants(df, {n: "" for n in names if n not in df.columns})


def fill_none(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.fillna("NONE", subset=cols)


def fill_empty(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.fillna("", subset=cols)


def category_flags(
    df: DataFrame, col: str = "categories", categories: list[str] = FLAG_CATEGORIES
) -> DataFrame:
    """One 0/1 column per category."""
    tokens = category_tokens(F.col(col))
    return df.withColumns(
        {
            flag_name(c): F.coalesce(F.array_contains(tokens, c), F.lit(False)).cast("int")
            for c in categories
        }
    )


def all_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def scalar_columns_only(df: DataFrame) -> DataFrame:
    """Only integer, floating-point and string columns."""
    kept = (T.IntegralType, T.FloatType, T.DoubleType, T.StringType)
    return select_cols(df, [f.name for f in df.schema if isinstance(f.dataType, kept)])
