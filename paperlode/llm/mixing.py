"""Mixing sources to target weights.

Documents get hash-random keys and are sorted within their source over many partitions; running
totals of their sizes are summed up across partitions; a source is cut at its exact budget, after
as many whole epochs as fit.

The document at the cut gives only as many words as the budget still has. Null text has size 0 and is
taken with nothing. A null source is a source of its own, last in order. Rows that are equal in key
and text may change places with each other. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlode.llm.common import numbered, unused, words
from paperlode.session import settle

#: Weights of the sources by order, repeated; the share of all words; the most epochs of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def hash_key(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """A random key for each document that depends only on the seed, its id and its text."""
    part = F.coalesce(doc_id.cast("string"), F.lit("-"))
    return F.md5(F.concat(F.lit(f"{seed}:"), part, F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    ``share`` times all words are dealt by weight; a source above ``most`` times its size stops
    there and the rest is dealt anew to the others, until none is above. One row for each round
    and no source comes to the driver.
    """
    order = F.col("source").isNull(), F.col("source")
    ordered, _ = numbered(sizes, list(order), "turn")
    turn = F.pmod("turn", F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    table = settle(ordered.withColumn("weight", weight).drop("turn").withColumn("full", F.lit(False)), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        kept = table.agg(
            F.sum(F.when(F.col("full"), most * F.col("source_size")).otherwise(0)),
            F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)),
            F.sum(F.col("full").cast("int")),
        ).first()
        free = (share * total - (kept[0] or 0)) / kept[1] if kept[1] else 0.0
        over = F.col("full") | (F.col("weight") * free > most * F.col("source_size"))
        new = table.withColumn("full", over)
        if new.filter("full").count() == (kept[2] or 0):
            target = F.when(F.col("full"), most * F.col("source_size").cast("double"))
            return table.withColumn("target", target.otherwise(F.col("weight") * F.lit(free))).drop(
                "weight", "full"
            )
        table = settle(new, "weights")


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    seed: int = 0,
    keep_text: bool = False,
    **rules,
) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target`` and ``taken``, which replace columns of
    these names.

    The columns of ``docs`` are kept, the text only on request. A source's ``taken`` adds up to its
    target, rounded down.
    """
    named = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*[c for c in named if c in docs.columns])
    key, at, part, before = (unused(docs, c) for c in ("mix_key", "mix_at", "mix_part", "mix_before"))
    sized = docs.withColumn("size", F.size(words(F.col(text))).cast("long")).withColumn(
        key, hash_key(F.col(doc_id), F.col(text), seed)
    )
    if not keep_text:
        sized = sized.drop(text)
    tie = unused(docs, "mix_tie")
    ordered = sized.withColumn(tie, F.monotonically_increasing_id()).orderBy(source, key, tie)
    laid = settle(ordered.drop(key, tie).withColumn(at, F.monotonically_increasing_id()), "mix")
    laid = laid.withColumn(part, F.shiftright(F.col(at), 33))

    parts = laid.groupBy(F.col(source).alias("source"), F.col(part).alias("part")).agg(
        F.sum("size").alias("part_size")
    )
    parts = settle(parts, "parts")
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    goal = targets(sizes, **rules)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "source", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("start")
    )
    plan = starts.join(
        goal.withColumnRenamed("source", "goal"), F.col("source").eqNullSafe(F.col("goal"))
    )
    whose, where, begin = (unused(laid, c) for c in ("plan_source", "plan_part", "plan_start"))
    renamed = {"source": whose, "part": where, "start": begin}
    plan = settle(plan.drop("goal").withColumnsRenamed(renamed), "plan")

    running = Window.partitionBy(part, source).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = laid.withColumn(before, F.coalesce(F.sum("size").over(running), F.lit(0)))
    out = rows.join(
        plan, (F.col(part) == F.col(where)) & F.col(source).eqNullSafe(F.col(whose))
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col(begin) - F.col(before)
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.withColumn("taken", taken.cast("long")).drop(at, part, before, begin, whose, where)


def dealt(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row for each time a document is taken; at a source's cut the row holds
    the words that are taken, which end with a whole word."""
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    rest = F.col("taken") - full * F.col("size")
    times = (full + F.when(rest > 0, 1).otherwise(0)).cast("int")
    copy = unused(mixed, "copy")
    last = F.col(copy) > full
    part = F.array_join(F.slice(words(F.col(text)), F.lit(1), rest.cast("int")), " ")
    return (
        mixed.filter(times > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
        .withColumn(text, F.when(last, part).otherwise(F.col(text)))
        .drop(copy)
    )

