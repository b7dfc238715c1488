"""Already fetched web pages to rows: paper listings, author pages, titles, links."""

from __future__ import annotations

from html import unescape

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperlode.functions.text import join_names, paper_id, strip, url_venue, url_year


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(unescape, na_action="ignore")


def _plain(html: Column) -> Column:
    """Markup removed; entities stay."""
    return F.regexp_replace(html, r"<[^>]*>", "")


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""\s{name}\s*=\s*["']([^"']*)["']""", 1)


def _contents(html: Column, start: str, tag: str) -> Column:
    """What stands inside the elements whose opening matches ``start``. Elements of the same
    name inside belong to the content; where tags do not pair, it ends at the first end tag."""
    paired = rf"(?P<inner>(?:[^<]++|<(?!/?{tag}\b)|<{tag}\b[^>]*>(?&inner)</{tag}\s*>)*+)"
    end = rf"</{tag}\s*>"
    pattern = regex.compile(rf"{start}(?:(?P<text>{paired}){end}|(?s:(?P<rest>.*?)){end})", regex.ASCII)

    def find(page: str) -> list[str]:
        found = (m.group("text", "rest") for m in pattern.finditer(page))
        return [rest if text is None else text for text, rest in found]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def contents(pages: pd.Series) -> pd.Series:
        return pages.map(find)

    return F.transform(contents(html), _plain)


def _elements(html: Column, tag: str, attribute: str, value: str) -> Column:
    """Inner texts of elements with an attribute value."""
    return _contents(html, rf"""<{tag}\b[^>]*\s{attribute}\s*=\s*["']{value}["'][^>]*>""", tag)


def _blocks(pages: DataFrame, before: str) -> DataFrame:
    """One row per piece of a page that starts at a tag matching ``before``; the piece ends
    where the next one starts, or with its citation element."""
    return (
        pages.withColumn("block", F.explode(F.split("html", rf"(?s)(?={before})")))
        .withColumn("block", F.substring_index("block", "</cite>", 1))
        .withColumn("tag", F.regexp_extract("block", rf"(?s)^{before}[^>]*>", 0))
        .filter(F.col("tag") != "")
    )


def extract_listing(pages: DataFrame) -> DataFrame:
    """Papers of listing pages (``url``, ``html``): year and venue come from the url, the id
    from the entry or, failing that, from a hash of the title."""
    entries = _blocks(pages, r"""<[a-z]+\b[^>]*\sclass\s*=\s*["']entry\b""").filter(
        _attribute(F.col("tag"), "class") == "entry inproceedings"
    )
    block = F.col("block")
    title = F.get(_elements(block, "span", "class", "title"), 0)
    names = _elements(block, "span", "itemprop", "name")
    found = entries.select(
        url_year(F.col("url")).alias("year"),
        url_venue(F.col("url")).alias("venue"),
        _unescape(strip(F.coalesce(title, F.lit("")))).alias("title"),
        F.nullif(_attribute(F.col("tag"), "id"), F.lit("")).alias("given"),
        _unescape(join_names(names)).alias("authors"),
    )
    return found.select(
        "year", "venue", "title", paper_id(F.col("given"), F.col("title")).alias("dblp_id"), "authors"
    )


def extract_author_page(pages: DataFrame) -> DataFrame:
    """Articles of author pages: title, authors, venue, year (all strings)."""
    entries = _blocks(
        pages, r"""<li\b[^>]*\sitemtype\s*=\s*["']https?://schema.org/ScholarlyArticle["']"""
    )
    block = F.col("block")
    names = _elements(block, "span", "itemprop", "name")
    venue = _contents(
        block, r"""(?s:itemprop\s*=\s*["']isPartOf["'].*?itemprop\s*=\s*["']name["'][^>]*>)""", "span"
    )
    title = _contents(
        block, r"""<(?P<tag>\w+)\b[^>]*\sclass\s*=\s*["']title["'][^>]*>""", "(?P=tag)"
    )
    first = lambda found: strip(F.coalesce(F.get(found, 0), F.lit("")))
    year = F.get(_elements(block, "span", "itemprop", "datePublished"), 0)
    return entries.select(
        _unescape(first(title)).alias("title"),
        _unescape(join_names(names)).alias("author"),
        _unescape(first(venue)).alias("venue"),
        strip(year).alias("year"),
    )


def extract_title(pages: DataFrame) -> DataFrame:
    """``page_id`` and the text of the title element, trimmed, entities kept."""
    title = F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", strip(title).alias("title"))


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per link: ``page_id``, its position on the page, and the target."""
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(links).alias("position", "href"))
