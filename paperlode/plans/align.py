"""Source tables to the one aligned paper schema, and the searchable corpus built from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from paperlode.functions.text import doc_text, paper_url, title_with_id, year_or_default
from paperlode.operators.columns import (
    add_constants,
    category_flags,
    ensure_text_cols,
    fill_none,
    rename_cols,
    scalar_columns_only,
    select_cols,
)
from paperlode.operators.embedding import embed
from paperlode.operators.ids import with_uuid
from paperlode.operators.sets import union_all
from paperlode.schemas import FLAG_COLUMNS


def align_acl(df: DataFrame) -> DataFrame:
    papers = select_cols(df, ["title", "abstract", "author", "url", "year"])
    papers = rename_cols(papers, {"author": "authors"}).withColumn("year", F.col("year").try_cast("int"))
    return add_constants(papers, {"acl": 1, **{flag: 0 for flag in FLAG_COLUMNS}})


def align_arxiv(df: DataFrame) -> DataFrame:
    papers = df.select(
        title_with_id(F.col("id"), F.col("title")).alias("title"),
        "abstract",
        "authors",
        paper_url(F.col("id"), "www").alias("url"),
        year_or_default(F.col("update_date")).alias("year"),
        "categories",
    )
    return category_flags(add_constants(papers, {"acl": 0}))


_ALIGN = {"acl": align_acl, "arxiv": align_arxiv}


def align(df: DataFrame, source: str) -> DataFrame:
    """A source table in the aligned schema."""
    if source not in _ALIGN:
        raise ValueError(f"unknown source: {source}")
    return _ALIGN[source](df)


def build_corpus(sources: Mapping[str, DataFrame], key: str | None = None, **embedding) -> DataFrame:
    """All sources aligned, with document text, id and vector. Write the result once: without
    ``key`` its ids are random."""
    papers = union_all(*[align(ensure_text_cols(df, ["title", "abstract"]), name) for name, df in sources.items()])
    texts = papers.withColumn("document", doc_text(F.col("title"), F.col("abstract")))
    records = fill_none(scalar_columns_only(with_uuid(texts, key)))
    return embed(records, "document", **embedding)
