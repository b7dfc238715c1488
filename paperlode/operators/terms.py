"""Term tables: tokenising, vocabulary normalisation, term and corpus statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlode.functions.text import STOP_WORDS, bind, counted, plural_stem, terms, without_stop_words


def tokenize(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per term occurrence: id, ``term``."""
    return df.select(id_col, F.explode(terms(F.col(text))).alias("term"))


def remove_stopwords(tokens: DataFrame, words: list[str] = STOP_WORDS) -> DataFrame:
    return tokens.filter(~F.col("term").isin(words))


def doc_terms(
    df: DataFrame, id_col: str, text: str, normalize: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``doc_len`` and its distinct terms with counts.

    Counting happens inside the row, so no token is ever shuffled.
    """
    words = without_stop_words(terms(F.col(text)))
    if normalize is not None:
        words = F.transform(words, lambda w: normalize(w))
    packed = bind(
        words, lambda w: F.struct(F.size(w).alias("doc_len"), counted(w).alias("terms"))
    )
    return df.select(F.col(id_col).alias("doc_id"), packed.alias("p")).select(
        "doc_id", "p.doc_len", "p.terms"
    )


def term_frequency(df: DataFrame, text: str, n: int = 200) -> DataFrame:
    """The n most frequent terms with their count and their weight relative to the first."""
    words = without_stop_words(terms(F.col(text)))
    counts = (
        df.select(F.explode(words).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("freq"))
    )
    top = counts.orderBy(F.desc("freq"), F.asc("term")).limit(n)
    most = F.max("freq").over(Window.partitionBy())  # over the n rows that are left
    return top.select("term", "freq", F.round(F.col("freq") / most, 6).alias("weight"))


def normalize_vocab(terms_df: DataFrame, fn: Callable[[Column], Column] = plural_stem) -> DataFrame:
    """``term``, ``norm`` for the distinct terms. ``fn`` may be a Column expression or a pandas
    UDF; either way it runs once per distinct term, not once per occurrence."""
    return terms_df.select("term").distinct().withColumn("norm", fn(F.col("term")))


def apply_vocab(postings: DataFrame, vocab: DataFrame) -> DataFrame:
    """Postings re-counted by normalised term.

    Terms that the normaliser leaves alone need no lookup, so only the changed part of the
    vocabulary is joined; frequent short words rarely change, and AQE splits those that do.
    """
    changed = vocab.filter(F.col("norm") != F.col("term"))
    return (
        postings.join(changed, "term", "left")
        .groupBy("doc_id", F.coalesce("norm", "term").alias("term"))
        .agg(F.sum("tf").cast("int").alias("tf"), F.first("doc_len").alias("doc_len"))
        .select("term", "doc_id", "tf", "doc_len")
    )


def corpus_stats(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Term statistics: ``term``, ``df`` (documents), ``cf`` (occurrences)."""
    # The outer form keeps Spark from testing the computed array for emptiness first, which would
    # tokenise every text again.
    each = doc_terms(df, id_col, text).select(F.explode_outer("terms").alias("t")).filter("t IS NOT NULL")
    return each.groupBy(F.col("t.term").alias("term")).agg(
        F.count("*").alias("df"), F.sum("t.tf").alias("cf")
    )


def length_stats(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row: ``n_docs``, ``total_len``, ``avg_len``."""
    size = F.size(without_stop_words(terms(F.col(text))))
    return df.select(size.alias("doc_len")).agg(
        F.count("*").alias("n_docs"), F.sum("doc_len").alias("total_len"), F.avg("doc_len").alias("avg_len")
    )
