"""Schemas of the stored tables (as DDL, ready for a reader) and the fixed names they use."""

from __future__ import annotations

# Subject categories that become 0/1 flags, in flag order.
FLAG_CATEGORIES = ["cs.CL", "cs.SE", "cs.CR", "cs.LG", "cs.AI", "cs.IR"]

# Metadata columns left out of the narrow metadata table.
DROPPED_METADATA = ["license", "versions", "authors_parsed"]

# Fields of an anthology entry.
ANTHOLOGY_FIELDS = [
    "url", "publisher", "address", "year", "month", "editor", "title", "abstract", "pages",
    "doi", "booktitle", "author", "volume", "journal", "language", "isbn", "note",
]

LISTING = "year INT, venue STRING, title STRING, dblp_id STRING, authors STRING"

METADATA = (
    "id STRING, submitter STRING, authors STRING, title STRING, comments STRING, "
    "`journal-ref` STRING, doi STRING, `report-no` STRING, categories STRING, license STRING, "
    "abstract STRING, versions ARRAY<STRUCT<version: STRING, created: STRING>>, "
    "update_date STRING, authors_parsed ARRAY<ARRAY<STRING>>"
)

ID_MAP = "arxiv_id STRING, int_id BIGINT"
EMBEDDING = "int_id BIGINT, embedding ARRAY<FLOAT>"
IR_DOCUMENTS = "doc_id STRING, text STRING"
IR_QUERIES = "query_id STRING, text STRING"
IR_QRELS = "query_id STRING, doc_id STRING, relevance INT"


def flag_name(category: str) -> str:
    """Column name of a category flag (dots need quoting in Spark)."""
    return category.replace(".", "_").lower()


FLAG_COLUMNS = [flag_name(c) for c in FLAG_CATEGORIES]
