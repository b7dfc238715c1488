"""Row filters. All are plain predicates, so they reach the scan where the format allows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from paperlode.functions.resources import TEX_DOCUMENT, amount
from paperlode.functions.text import bind


def category_like(df: DataFrame, text: str, col: str = "categories") -> DataFrame:
    return df.filter(F.col(col).contains(text))


def date_from(df: DataFrame, col: str, start: str) -> DataFrame:
    """Rows whose ISO date string (years of four digits) is a date not before ``start``. The
    bound on the string itself reaches the scan; it keeps all that the one on the date keeps."""
    late = F.try_to_date(F.col(col), "yyyy-MM-dd") >= F.lit(start).cast("date")
    return df.filter((F.col(col) >= start) & late)


def in_list(df: DataFrame, col: str, values: Iterable[object]) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def year_closed(df: DataFrame, start: int, end: int, col: str = "year") -> DataFrame:
    return df.filter(F.col(col).between(start, end))


def year_half_open(df: DataFrame, start: int, end: int, col: str = "year") -> DataFrame:
    return df.filter((F.col(col) >= start) & (F.col(col) < end))


def recent_only(df: DataFrame, col: str, as_of: str, days: int = 5 * 365) -> DataFrame:
    """Rows dated at most ``days`` before ``as_of``; rows without a valid date are left out."""
    return date_from(df, col, (date.fromisoformat(as_of) - timedelta(days=days)).isoformat())


def category_prefix(df: DataFrame, prefix: str, col: str = "categories") -> DataFrame:
    tokens = F.split(F.col(col), r"\s+")
    return df.filter(F.exists(tokens, lambda t: t.startswith(prefix)))


def all_of(df: DataFrame, *predicates: Column) -> DataFrame:
    return df.filter(reduce(and_, predicates, F.lit(True)))


def min_count(df: DataFrame, col: str, n: int, start: int, end: int, year: str = "year") -> DataFrame:
    return year_closed(df.filter(F.col(col) >= n), start, end, year)


_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
}


def build_filter(spec: Mapping[str, object]) -> Column:
    """A metadata filter such as ``{"$and": [{"year": {"$gte": 2022}}, {"acl": 1}]}``.

    Several keys at one level must all hold; an empty spec keeps every row.
    """
    parts = []
    for key, value in spec.items():
        if key == "$and":
            parts.append(reduce(and_, map(build_filter, value), F.lit(True)))
        elif key == "$or":
            parts.append(reduce(or_, map(build_filter, value), F.lit(False)))
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator: {key}")
        else:
            tests = value if isinstance(value, Mapping) else {"$eq": value}
            for name, operand in tests.items():
                if name not in _COMPARE:
                    raise ValueError(f"unknown filter operator: {name}")
                parts.append(_COMPARE[name](F.col(f"`{key}`"), operand))
    return reduce(and_, parts) if parts else F.lit(True)


def doc_contains(df: DataFrame, text: str, col: str = "document") -> DataFrame:
    return df.filter(F.col(col).contains(text))


def apply_defaults(
    df: DataFrame,
    venues: list[str] | None = None,
    start: int | None = None,
    end: int | None = None,
    venue: str = "venue",
    year: str = "year",
) -> DataFrame:
    """Venue and year filters where a missing bound means the smallest or largest year and
    missing venues mean all. A missing bound is always met by a known year, so no extra pass
    is needed to look it up; rows without a year are left out either way."""
    if venues:
        df = in_list(df, venue, venues)
    df = df.filter(F.col(year).isNotNull())
    if start is not None:
        df = df.filter(F.col(year) >= start)
    if end is not None:
        df = df.filter(F.col(year) <= end)
    return df


def fully_free(df: DataFrame, cfg: str, alloc: str) -> DataFrame:
    """Records whose configured resources all exceed what is allocated (maps of text)."""

    def free(node: Column) -> Column:
        used = F.coalesce(node["alloc"], F.create_map().cast("map<string,string>"))
        return F.forall(
            F.map_keys(node["cfg"]),
            lambda k: F.coalesce(amount(k, F.try_element_at(used, k)), F.lit(0))
            < amount(k, F.element_at(node["cfg"], k)),
        ) & (F.size(F.map_keys(node["cfg"])) > 0)

    maps = F.struct(F.col(cfg).alias("cfg"), F.col(alloc).alias("alloc"))
    return df.filter(bind(maps, free))


def main_tex_candidates(df: DataFrame) -> DataFrame:
    return df.filter(F.col("text").contains(TEX_DOCUMENT))


def valid_hits(hits: DataFrame, col: str = "doc_id") -> DataFrame:
    """Hits without the -1 placeholders of a search that found too few neighbours."""
    return hits.filter(F.col(col) != -1)
