"""Column expressions on titles, names, urls and queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# A term is two or more letters, digits or underscores.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

# English stop words (the classic Lucene list).
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is",
    "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "will", "with",
]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, with ``value`` evaluated once per row however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Blanks, tabs and line ends removed at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def title_with_id(paper_id: Column, title: Column) -> Column:
    """``[id] title``; null for a null title."""
    return F.when(title.isNotNull(), F.format_string("[%s] %s", paper_id, title))


def paper_url(paper_id: Column, kind: str = "abs") -> Column:
    """Abstract page (``abs``), its ``www`` form (``www``) or PDF link (``pdf``) of a paper."""
    if kind == "abs":
        return F.concat(F.lit("https://arxiv.org/abs/"), paper_id)
    if kind == "www":
        return F.concat(F.lit("https://www.arxiv.org/abs/"), paper_id)
    if kind == "pdf":
        return F.concat(F.lit("https://arxiv.org/pdf/"), paper_id, F.lit(".pdf"))
    raise ValueError(f"unknown link kind: {kind}")


def doc_text(title: Column, abstract: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws(" ", F.coalesce(title, empty), F.coalesce(abstract, empty))


def year_or_default(date: Column, default: int = 1900) -> Column:
    """Year of an ISO date string; ``default`` when it is missing or not a date."""
    return F.coalesce(F.year(F.try_to_date(date, "yyyy-MM-dd")), F.lit(default))


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def url_year(url: Column) -> Column:
    """First run of four digits in a url; null when there is none."""
    return F.nullif(F.regexp_extract(url, r"\d{4}", 0), F.lit("")).cast("int")


def url_venue(url: Column) -> Column:
    """Upper-cased path part after ``db/conf/``, else ``UNKNOWN``."""
    venue = F.upper(F.regexp_extract(url, r"db/conf/([^/]+)/", 1))
    return F.coalesce(F.nullif(venue, F.lit("")), F.lit("UNKNOWN"))


def join_names(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: strip(n)), ", ")


def author_string(parsed: Column) -> Column:
    """``[[last, first, suffix], ...]`` to ``suffix first last, ...``."""
    return F.array_join(
        F.transform(parsed, lambda parts: strip(F.array_join(F.reverse(parts), " "))), ", "
    )


def paper_id(given: Column, title: Column) -> Column:
    """The given id, else the SHA-256 of the title."""
    return F.coalesce(given, F.sha2(title, 256))


def safe_name(query: Column) -> Column:
    return F.lower(F.replace(query, F.lit(" "), F.lit("_")))


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, also after hyphens and quotes. A first letter whose
    capital is two letters keeps the second one small."""

    def capital(run: Column) -> Column:
        first = F.upper(F.substring(run, 1, 1))
        return F.concat(
            F.substring(first, 1, 1),
            F.lower(F.concat(F.substring(first, 2, 2), F.substring(run, F.lit(2), F.length(run)))),
        )

    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, capital), "")


def query_text(query: Column) -> Column:
    """``"a, b ,c"`` to ``"a b c"``."""
    return F.array_join(F.transform(F.split(query, ","), lambda part: strip(part)), " ")


def prefixed_query(
    query: Column, prefix: str = "Represent this sentence for searching relevant passages: "
) -> Column:
    return F.concat(F.lit(prefix), query)


def shared(left: Column, right: Column) -> Column:
    return F.array_intersect(left, right)


def category_tokens(categories: Column) -> Column:
    """Categories split on commas or blanks."""
    return F.split(F.trim(categories), r"[,\s]+")


def terms(text: Column) -> Column:
    """Lower-cased terms of a text in reading order; an empty array for a null text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def without_stop_words(words: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words


def counted(words: Column) -> Column:
    """Distinct values of an array with their counts, without a shuffle: sort the array,
    keep the positions where a new value starts, and take the gaps as counts."""

    def starts(ordered: Column) -> Column:
        marks = F.transform(
            ordered,
            lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - F.lit(1))), i),
        )
        return F.filter(marks, lambda i: i.isNotNull())

    def runs(ordered: Column) -> Column:
        return bind(
            starts(ordered),
            lambda at: F.transform(
                at,
                lambda start, n: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(at, n + F.lit(1)), F.size(ordered)) - start).alias("tf"),
                ),
            ),
        )

    return bind(F.sort_array(words), runs)


def plural_stem(term: Column) -> Column:
    """Plural-only stemmer (Harman 1991): ``ies`` becomes ``y``, any other final ``s`` goes, but
    not after ``u`` or ``s``, nor in ``aes``, ``ees``, ``oes``, ``aies`` or ``eies``, nor in words
    of two letters."""
    return (
        F.when(term.rlike("[^ae]ies$"), F.regexp_replace(term, "ies$", "y"))
        .when(term.rlike("[aeio]es$|[us]s$|^.{1,2}$"), term)
        .otherwise(F.regexp_replace(term, "s$", ""))
    )
