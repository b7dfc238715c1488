"""Ranked hits as markdown, JSON and catalog lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperlode.functions.text import paper_url, safe_name, title_case


def markdown_report(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """One markdown text per query from its ranked hits (``rank`` from 0, ``arxiv_id``,
    ``update_date``, ``title``, ``abstract``, ``authors``). A query's hits are at most the
    search depth, so a report is small."""
    block = F.format_string(
        "**[%d. [%s] %s](%s)** (%s)\n\n*%s*\n\n%s\n\n---\n",
        (F.col("rank") + 1).cast("bigint"), "arxiv_id", "title", paper_url(F.col("arxiv_id"), "pdf"),
        "update_date", "authors", "abstract",
    )
    return (
        hits.select(by, "rank", block.alias("block"))
        .groupBy(by)
        .agg(F.expr("listagg(block, '\\n') WITHIN GROUP (ORDER BY rank)").alias("report"))
    )


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("report").write.text(path, lineSep="\n")


def export_json(df: DataFrame, by: str, order: str) -> DataFrame:
    """One JSON array of records per group, in ``order``. For result lists of bounded length."""
    fields = [c for c in df.columns if c != by]
    record = F.struct(order, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
    ordered = F.transform(F.array_sort(F.collect_list(record)), lambda r: r["json"])
    return df.groupBy(by).agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("records"))


def report_catalog(runs: DataFrame) -> DataFrame:
    """Path and catalog line of every search run (``query``, ``run_date``)."""
    stamp = F.date_format("run_date", "yyyyMMdd")
    path = F.concat(
        F.date_format("run_date", "yyyy/MM/"), stamp, F.lit("_"), safe_name(F.col("query")), F.lit(".md")
    )
    return runs.withColumn("path", path).withColumn(
        "line",
        F.concat(F.lit("- ["), title_case(F.col("query")), F.lit(" ("), stamp, F.lit(")]("), "path", F.lit(")")),
    )
