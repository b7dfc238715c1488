"""BibTeX files to one row per entry."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from paperlode.functions.resources import last_wins
from paperlode.functions.text import strip

_ENTRY = r"^\s*@?(\w+)\s*\{\s*([^,\s{}]+)\s*,"
_NOT_ENTRIES = ["comment", "string", "preamble"]


# One ``name = value`` item; brace groups nest to any depth.
_ITEM = regex.compile(
    r"[\w-]+\s*=\s*(?:(?P<group>\{(?:[^{}]++|(?&group))*+\})"
    r'|"(?:[^"{}]++|(?&group))*+"|[^\s,{}"]+)',
    regex.ASCII,
)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _items(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda body: [m.group() for m in _ITEM.finditer(body)])


def _fields(entry: Column) -> Column:
    """``name = {value}``, ``name = "value"`` or ``name = word`` items as a map."""

    def pair(item: Column) -> Column:
        raw = strip(F.substring(item, F.instr(item, "=") + F.lit(1), F.length(item)))
        return F.struct(
            F.lower(strip(F.substring_index(item, "=", 1))).alias("key"),
            F.regexp_replace(raw, r'^["{]|["}]$', "").alias("value"),
        )

    return last_wins(F.transform(_items(entry), pair))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of BibTeX files: ``ID``, ``ENTRYTYPE`` and a ``fields`` map.

    The text scan splits on lines that start with ``@``, so a large file is read by many
    tasks; entries indented before their ``@`` are split off inside the row.
    """
    chunks = spark.read.option("lineSep", "\n@").text(path)
    entries = chunks.select(F.explode(F.split("value", r"\n\s*@")).alias("entry"))
    parsed = entries.select(
        F.regexp_extract("entry", _ENTRY, 2).alias("ID"),
        F.lower(F.regexp_extract("entry", _ENTRY, 1)).alias("ENTRYTYPE"),
        F.regexp_replace("entry", _ENTRY, "").alias("body"),
    )
    return parsed.filter((F.col("ID") != "") & ~F.col("ENTRYTYPE").isin(_NOT_ENTRIES)).select(
        "ID", "ENTRYTYPE", _fields(F.col("body")).alias("fields")
    )


def entry_columns(entries: DataFrame, names: list[str]) -> DataFrame:
    """Entries with the named fields as string columns; missing fields are null."""
    fields = [F.try_element_at("fields", F.lit(name)).alias(name) for name in names]
    return entries.select("ID", "ENTRYTYPE", *fields)
