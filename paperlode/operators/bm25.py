"""BM25 keyword ranking (Lucene form, k1 = 1.5, b = 0.75).

Two ways to search. ``score_docs`` scores a table of texts in one pass without any index:
right for ad-hoc questions and for full rankings. A stored ``Bm25Index`` is laid out by term in
blocks, each with the most that a posting in it can add to a score, so a search reads only the
files that hold the query's terms, and of their postings only blocks that can hold a hit.

Scores are rounded to 6 places and ties go to the lower id: copies of a text must tie.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlode.functions.text import bind, terms, without_stop_words
from paperlode.operators.ranking import top_k_per, top_n
from paperlode.operators.terms import apply_vocab, doc_terms, normalize_vocab
from paperlode.session import settle

K1 = 1.5
B = 0.75
DIGITS = 6


# Documents of a block on average, and steps of length up to its double that are kept apart.
BLOCK_DOCS = 4_096
LENGTH_STEPS = 1
# Blocks of a query that are scored first, for the score that other blocks have to reach.
FIRST_BLOCKS = 8
# Queries that ask the same rows of the index together.
ASKERS = 1_024


class Bm25Index(NamedTuple):
    blocks: DataFrame  # term, block, n, bound, hits: array of (doc_id, tf, doc_len)
    docs: DataFrame  # doc_id, doc_len: one row per document
    term_stats: DataFrame  # term, df
    totals: DataFrame  # n_docs, avg_len (one row)

    @property
    def postings(self) -> DataFrame:
        """One row per document and term: term, doc_id, tf, doc_len."""
        return self.blocks.select("term", F.inline("hits"))


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def _tf_part(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf / (tf + K1 * (1.0 - B + B * doc_len / avg_len))


def query_terms(spark: SparkSession, query: str) -> dict[str, int]:
    """Terms of one query string with their counts, in term order."""
    words = spark.sql("SELECT :query AS q", args={"query": query}).select(
        without_stop_words(terms(F.col("q"))).alias("w")
    )
    return dict(sorted(Counter(words.first()["w"]).items()))


def bm25_index(
    df: DataFrame, id_col: str, text: str, normalize: Callable[[Column], Column] | None = None
) -> Bm25Index:
    """The index tables of a corpus. ``id_col`` must be unique.

    The texts are tokenised once: the counted terms of every document go to the shared folder,
    and all tables are made from there. ``normalize`` is a function on term columns; a built-in
    expression is applied inside the row, a pandas UDF once per distinct term.

    A block holds the documents of one class of lengths with one hash of the id. A short text is
    worth more per occurrence than a long one, so blocks of few classes hold the best hits. The
    postings are shuffled once, by range of term and block: a term found in a large part of the
    corpus is spread over several files and the others share one.
    """
    by_vocabulary = normalize is not None and hasattr(normalize, "evalType")
    docs = settle(doc_terms(df, id_col, text, None if by_vocabulary else normalize), "doc-terms")
    if by_vocabulary:
        postings = _postings(docs)
        postings = apply_vocab(postings, normalize_vocab(postings, normalize))
        lists = postings.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
        docs = settle(docs.select("doc_id", "doc_len").join(lists, "doc_id", "left"), "doc-terms")
    totals = settle(docs.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len")), "totals")
    postings = _postings(docs.join(F.broadcast(_classes(docs)), _length_class() == F.col("class")), "block")
    impact = _tf_part(F.col("tf"), F.col("doc_len"), totals.select("avg_len").scalar())
    blocks = (
        postings.repartitionByRange("term", "block")
        .groupBy("term", "block")
        .agg(
            F.count("*").alias("n"),
            F.max(impact).alias("bound"),
            F.collect_list(F.struct("doc_id", "tf", "doc_len")).alias("hits"),
        )
        .sortWithinPartitions("term", "block")
    )
    blocks = settle(blocks, "blocks")
    stats = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    return Bm25Index(blocks, docs.select("doc_id", "doc_len"), stats, totals)


def _length_class() -> Column:
    """Lengths by steps of their logarithm: 31 * LENGTH_STEPS classes at most."""
    return F.floor(F.log2(F.col("doc_len") + 1) * LENGTH_STEPS)


def _classes(docs: DataFrame) -> DataFrame:
    """Into how many blocks each class of lengths is dealt out; one row for each class."""
    counts = docs.groupBy(_length_class().alias("class")).agg(F.count("*").alias("size"))
    return counts.select("class", F.ceil(F.col("size") / BLOCK_DOCS).alias("in_class"))


def _postings(docs: DataFrame, *more: str) -> DataFrame:
    if more:
        part = F.pmod(F.xxhash64("doc_id"), F.col("in_class"))
        docs = docs.withColumn("block", F.shiftleft(F.col("class"), 40) + part)
    return docs.select(F.explode("terms").alias("t"), "doc_id", "doc_len", *more).select(
        "t.term", "doc_id", "t.tf", "doc_len", *more
    )


# Folder of each table of a stored index.
_FOLDERS = {"blocks": "postings", "docs": "docs", "term_stats": "term_stats", "totals": "totals"}


def write_index(index: Bm25Index, path: str) -> None:
    """Store the index. Blocks are range-partitioned on (term, block) and sorted, which gives the
    row groups tight term bounds for pruning."""
    stats = index.term_stats.sortWithinPartitions("term")
    for name, table in index._replace(term_stats=stats)._asdict().items():
        table.write.parquet(f"{path}/{_FOLDERS[name]}")


def read_index(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(**{name: spark.read.parquet(f"{path}/{folder}") for name, folder in _FOLDERS.items()})


def bm25_search(
    index: Bm25Index,
    query: str,
    k: int,
    normalize: Callable[[Column], Column] | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """The k best documents for one query: ``doc_id``, ``score``. Only blocks of the query's
    terms are read. ``among`` (``doc_id``) narrows the documents that can be hits; statistics stay
    those of the whole index."""
    spark = index.blocks.sparkSession
    queries = spark.sql("SELECT 0L AS query_id, :query AS text", args={"query": query})
    if normalize is None:
        wanted = F.col("term").isin(list(query_terms(spark, query)))
        index = index._replace(
            blocks=index.blocks.filter(wanted), term_stats=index.term_stats.filter(wanted)
        )
    return top_n(_best(index, queries, k, normalize, among).select("doc_id", "score"), "score", k, "doc_id")


def bm25_batch(
    index: Bm25Index,
    queries: DataFrame,
    k: int,
    normalize: Callable[[Column], Column] | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """The k best documents per query (``query_id``, ``text``), with ranks: one way for any
    number of queries and terms."""
    return _best(index, queries, k, normalize, among)


def _best(
    index: Bm25Index,
    queries: DataFrame,
    k: int,
    normalize: Callable[[Column], Column] | None,
    among: DataFrame | None,
) -> DataFrame:
    """The k best per query, block by block (Ding and Suel 2011).

    The bounds of a query's terms, added up, tell the most that a document of a block can score.
    The most promising blocks are scored first; their k-th best score is what a document has to
    reach, and of the other blocks only those whose bound reaches it are read. A document is in one
    block, so its score is complete there.
    """
    weights = settle(_weights(index, queries, normalize), "weights")
    together = F.lit(max(1, -(-weights.select("query_id").distinct().count() // ASKERS)))
    bounds = settle(block_bounds(index, weights), "bounds")
    first = top_k_per(bounds, "query_id", "most", FIRST_BLOCKS, tie="block").drop("rank")
    first = settle(first, "first-blocks")
    best = settle(top_k_per(_scores(index, weights, first, together, among), "query_id", "score", k), "best")
    rest = still_possible(bounds, first, best, k)
    found = best.drop("rank").unionByName(_scores(index, weights, rest, together, among))
    return top_k_per(found, "query_id", "score", k)


def block_bounds(index: Bm25Index, weights: DataFrame) -> DataFrame:
    """``query_id``, ``block``, ``most``: what a document of the block can score at most."""
    part = F.col("weight") * F.col("bound")
    asked = index.blocks.select("term", "block", "bound").join(weights, "term")
    return asked.groupBy("query_id", "block").agg(F.sum(part).alias("most"))


def still_possible(bounds: DataFrame, first: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The blocks, other than the first, that can hold a hit among the k best."""
    floor = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    left = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti")
    reached = F.col("floor").isNull() | (F.col("most") >= F.col("floor") - 10.0**-DIGITS)
    return left.join(floor, "query_id", "left").filter(reached).drop("floor")


def _query_words(
    queries: DataFrame, normalize: Callable[[Column], Column] | None
) -> DataFrame:
    words = without_stop_words(terms(F.col("text")))
    found = queries.select("query_id", F.explode(words).alias("term"))
    return found if normalize is None else found.withColumn("term", normalize(F.col("term")))


def _weights(
    index: Bm25Index, queries: DataFrame, normalize: Callable[[Column], Column] | None
) -> DataFrame:
    """Per query and term: the idf times the number of times the query repeats the term."""
    found = _query_words(queries, normalize)
    repeats = found.groupBy("query_id", "term").agg(F.count("*").alias("repeats"))
    idf = _idf(index.totals.select("n_docs").scalar(), F.col("df"))
    # The semi join moves below the counting of documents per term: only query terms are counted.
    stats = index.term_stats.join(found.select("term").distinct(), "term", "left_semi")
    return repeats.join(stats, "term").select(
        "query_id", "term", (F.col("repeats") * idf).alias("weight")
    )


def _scores(
    index: Bm25Index,
    weights: DataFrame,
    blocks: DataFrame,
    together: Column,
    among: DataFrame | None = None,
) -> DataFrame:
    """Score of every document in the given blocks (``query_id``, ``block``) that shares a term
    with the query.

    Rows of the index move as they are, packed, to where their block is scored; what asks for them
    goes along as a list, split so that it stays short. Postings are unpacked and added up there.
    """
    asked = weights.join(blocks.select("query_id", "block"), "query_id")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), together))
    askers = asked.groupBy("term", "block", "part").agg(
        F.collect_list(F.struct("query_id", "weight")).alias("askers")
    )
    rows = index.blocks.select("term", "block", "hits").join(askers, ["term", "block"])
    rows = rows.repartition("block", "part").select("block", "part", "askers", F.inline("hits"))
    rows = rows.select("block", "part", "doc_id", "tf", "doc_len", F.inline("askers"))
    worth = _tf_part(F.col("tf"), F.col("doc_len"), index.totals.select("avg_len").scalar())
    scores = rows.groupBy("block", "part", "query_id", "doc_id").agg(
        F.round(F.sum(F.col("weight") * worth), DIGITS).alias("score")
    )
    scores = scores.select("query_id", "doc_id", "score")
    return scores if among is None else scores.join(among.select("doc_id"), "doc_id", "left_semi")


def _match(text: Column, wanted: list[str]) -> Column:
    """Length of a text and its occurrences of the wanted terms, from one tokenising."""
    return bind(
        terms(text),
        lambda words: F.struct(
            F.size(without_stop_words(words)).alias("doc_len"),
            F.filter(words, lambda w: w.isin(wanted)).alias("hits"),
        ),
    )


def _totals(matches: DataFrame, wanted: list[str]) -> Column:
    """Corpus size, mean length and document frequencies as one scalar struct."""
    dfs = F.array(*[F.count_if(F.array_contains("_m.hits", term)) for term in wanted])
    row = matches.agg(F.count("*").alias("n_docs"), F.avg("_m.doc_len").alias("avg_len"), dfs.alias("dfs"))
    return row.select(F.struct("n_docs", "avg_len", "dfs").alias("totals")).scalar()


def _score(counts: dict[str, int]) -> Column:
    """Score from the columns ``_m`` (match of the row) and ``_c`` (corpus totals)."""
    total = F.lit(0.0)
    for i, (term, repeats) in enumerate(counts.items()):
        tf = F.size(F.filter("_m.hits", lambda w: w == term))
        weight = repeats * _idf(F.col("_c.n_docs"), F.col("_c.dfs")[i])
        total = total + weight * _tf_part(tf, F.col("_m.doc_len"), F.col("_c.avg_len"))
    return F.when(F.size("_m.hits") > 0, F.round(total, DIGITS)).otherwise(0.0)


def score_docs(df: DataFrame, text: str, query: str, score: str = "score") -> DataFrame:
    """Every row of ``df`` with its score for one query; 0 when no term matches.

    Two scans and no shuffle of rows: the first counts documents, lengths and the query terms'
    document frequencies down to one row, the second scores each row on its own. Later filters
    and the column list reach the second scan.
    """
    counts = query_terms(df.sparkSession, query)
    if not counts:
        return df.withColumn(score, F.lit(0.0))
    match = _match(F.col(text), list(counts)).alias("_m")
    totals = _totals(df.select(match), list(counts))
    return df.select("*", match, totals.alias("_c")).withColumn(score, _score(counts)).drop("_m", "_c")


def bm25_topk(df: DataFrame, id_col: str, text: str, query: str, k: int) -> DataFrame:
    """The k best matching documents of an unindexed table: ``doc_id``, ``score``.

    The texts are read once: lengths and query-term occurrences, a few bytes per document, go
    to the shared folder, and both the corpus totals and the scores come from there.
    """
    counts = query_terms(df.sparkSession, query)
    ids = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text"))
    if not counts:
        return ids.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    matches = settle(ids.select("doc_id", _match(F.col("_text"), list(counts)).alias("_m")), "matches")
    scored = matches.select("doc_id", "_m", _totals(matches, list(counts)).alias("_c"))
    scored = scored.select("doc_id", _score(counts).alias("score"))
    return top_n(scored, "score", k, "doc_id").filter("score > 0")


def bm25_rank_all(index: Bm25Index, query: str) -> DataFrame:
    """Score of every indexed document, 0 where no term matches: ``doc_id``, ``score``."""
    spark = index.blocks.sparkSession
    queries = spark.sql("SELECT 0L AS query_id, :query AS text", args={"query": query})
    weights = settle(_weights(index, queries, None), "weights")
    hits = _scores(index, weights, block_bounds(index, weights), F.lit(1)).select("doc_id", "score")
    return (
        index.docs.select("doc_id")
        .join(hits, "doc_id", "left")
        .select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    )
