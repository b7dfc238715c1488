"""Which listing pages are due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Venues and the url forms of their yearly listings, and the years covered.
VENUE_PATTERNS = {
    "icse": [
        "https://dblp.org/db/conf/icse/icse{year}.html",
        "https://dblp.org/db/conf/icse/icse{year}c.html",
        "https://dblp.org/db/conf/icse/nier{year}.html",
    ],
    "ase": ["https://dblp.org/db/conf/kbse/ase{year}.html"],
    "fse": ["https://dblp.org/db/conf/sigsoft/fse{year}.html"],
    "icsme": ["https://dblp.org/db/conf/icsm/icsme{year}.html"],
    "saner": ["https://dblp.org/db/conf/wcre/saner{year}.html"],
    "msr": ["https://dblp.org/db/conf/msr/msr{year}.html"],
    "issta": ["https://dblp.org/db/conf/issta/issta{year}.html"],
    "re": [
        "https://dblp.org/db/conf/re/re{year}.html",
        "https://dblp.org/db/conf/re/re{year}w.html",
    ],
    "issre": [
        "https://dblp.org/db/conf/issre/issre{year}.html",
        "https://dblp.org/db/conf/issre/issre{year}w.html",
    ],
    "chi": [
        "https://dblp.org/db/conf/chi/chi{year}.html",
        "https://dblp.org/db/conf/chi/chi{year}w.html",
    ],
    "cscw": ["https://dblp.org/db/conf/cscw/cscw{year}c.html"],
    "iui": [
        "https://dblp.org/db/conf/iui/iui{year}.html",
        "https://dblp.org/db/conf/iui/iui{year}c.html",
        "https://dblp.org/db/conf/iui/iui{year}w.html",
    ],
    "emnlp": ["https://dblp.org/db/conf/emnlp/emnlp{year}.html"],
    "acl": [
        "https://dblp.org/db/conf/acl/acl{year}-1.html",
        "https://dblp.org/db/conf/acl/acl{year}-2.html",
    ],
    "naacl": [
        "https://dblp.org/db/conf/naacl/naacl{year}-1.html",
        "https://dblp.org/db/conf/naacl/naacl{year}-2.html",
    ],
    "dimva": ["https://dblp.org/db/conf/dimva/dimva{year}.html"],
    "ndss": ["https://dblp.org/db/conf/ndss/ndss{year}.html"],
    "uss": ["https://dblp.org/db/conf/uss/uss{year}.html"],
    "ccs": ["https://dblp.org/db/conf/ccs/ccs{year}.html"],
    "sp": [
        "https://dblp.org/db/conf/sp/sp{year}.html",
        "https://dblp.org/db/conf/sp/sp{year}w.html",
    ],
}
START_YEAR = 2000
END_YEAR = 2024


def venue_patterns(spark: SparkSession) -> DataFrame:
    rows = [(v, p) for v, patterns in VENUE_PATTERNS.items() for p in patterns]
    return spark.createDataFrame(rows, "venue STRING, pattern STRING")


def frontier(patterns: DataFrame, start: int = START_YEAR, end: int = END_YEAR) -> DataFrame:
    """Every (venue, url form) for every year, with its url."""
    return patterns.select(
        "venue", "pattern", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("year")
    ).withColumn("url", F.replace("pattern", F.lit("{year}"), F.col("year").cast("string")))


def stored_listings(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Sizes of what is stored below ``root`` for each venue and year; contents are not read. A
    listing is a file ``<venue>/<year>.json``, or a folder of files of that name or of the form
    ``venue=<venue>/year=<year>``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    form = r"/(?:venue=)?([^/]+)/(?:year=)?(\d+)(?:\.json)?(?:/[^/]+)?$"
    named = files.select(
        F.regexp_extract("path", form, 1).alias("venue"),
        F.regexp_extract("path", form, 2).try_cast("int").alias("year"),
        "length",
    )
    return named.groupBy("venue", "year").agg(F.sum("length").alias("length"))


def due_pages(pages: DataFrame, listing: DataFrame, min_kb: int = 5) -> DataFrame:
    """Pages whose (venue, year) has no stored file, or one of at most ``min_kb`` KB."""
    small = F.col("length").isNull() | (F.col("length") / 1024 <= min_kb)
    return pages.join(listing, ["venue", "year"], "left").filter(small).drop("length")
