"""Column expressions on resource strings and LaTeX text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperlode.functions.text import bind, strip

# Markers counted to find the main LaTeX file, and the one it must contain.
TEX_MARKERS = [r"\section", r"\begin", r"\cite"]
TEX_DOCUMENT = r"\begin{document}"


def resource_map(text: Column) -> Column:
    """``"cpu=4, mem=2G"`` to a map; items without ``=`` are left out, the last duplicate
    wins, and everything after the first ``=`` is the value."""
    items = F.filter(F.split(text, ","), lambda item: item.contains("="))
    pairs = F.transform(
        items,
        lambda item: F.struct(
            strip(F.substring_index(item, "=", 1)).alias("key"),
            strip(F.substring(item, F.instr(item, "=") + F.lit(1), F.length(item))).alias("value"),
        ),
    )
    return last_wins(pairs)


def last_wins(pairs: Column) -> Column:
    """Array of (key, value) structs to a map in which the last duplicate key counts: sorted by key
    and place, the last of each run of equal keys."""

    def kept(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda p, i: F.coalesce(F.get(ordered, i + F.lit(1))["key"] != p["key"], F.lit(True)),
        )

    placed = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value")))
    last = bind(F.array_sort(placed), kept)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def mem_mb(text: Column) -> Column:
    """``2G``, ``512M`` or ``7`` in MB, any case; null when the amount is not a whole number."""
    upper = F.upper(text)
    amount = F.regexp_replace(upper, "[GM]$", "").try_cast("bigint")
    return F.when(upper.endswith("G"), amount * 1024).otherwise(amount)


def amount(key: Column, value: Column) -> Column:
    return F.when(key.contains("mem"), mem_mb(value)).otherwise(value.try_cast("bigint"))


def tex_score(text: Column) -> Column:
    """How often the main-file markers occur."""
    count = F.lit(0)
    for marker in TEX_MARKERS:
        count = count + F.regexp_count(text, F.lit("\\" + marker))
    return count
