"""Host-level quality rules, with built-in functions only.

A document is measured and checked against rules; the failures of each rule are added up by
host; a host's rate is drawn towards the rate of all hosts by a beta prior fitted to the hosts;
the host's verdict goes back to its documents.

Null text has no words. A null host is a host of its own. Repeated rows count as often as they
stand in the table. An empty table gives an empty table. Columns of the input that have the name
of a result are replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import WORD, let, words
from paperlode.session import settle

#: A rule failed if its condition holds. The first two are the base rules of a document.
BASE_RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
}
HOST_RULES = {**BASE_RULES, "symbols": "10 * n_symbols > 5 * n_words"}
#: A host is rejected if the shrunk rate of any rule reaches this.
HOST_RATE = 0.75
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(tokens: Column, window: int = 3) -> Column:
    """How many words stand in windows of ``window`` words that occur twice or more.

    The windows are sorted with their places, so a text costs n log n and no word is shuffled.
    """

    def covered(places: Column) -> Column:
        steps = F.zip_with(
            places,
            F.slice(places, 2, F.size(places)),
            lambda a, b: F.least(F.lit(window), b - a),
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def same(w: Column, a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        for k in range(window):
            equal = equal & (F.get(w, a["i"] + k) == F.get(w, b["i"] + k))
        return equal

    def places(w: Column, ordered: Column) -> Column:
        pairs = F.zip_with(
            F.slice(ordered, 1, F.size(ordered) - 1),
            F.slice(ordered, 2, F.size(ordered) - 1),
            lambda a, b: F.when(same(w, a, b), F.array(a["i"], b["i"])),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))

    def count(w: Column, hashes: Column) -> Column:
        ordered = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))
        )
        found = let(ordered, lambda s: let(places(w, s), covered))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(0)

    def found(w: Column) -> Column:
        hashes = F.transform(
            F.slice(w, 1, F.size(w) - (window - 1)),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]),
        )
        return let(hashes, lambda h: count(w, h))

    return F.when(F.size(tokens) > window, found(tokens)).otherwise(0).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the columns of ``MEASURES``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    n_dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    by_words = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    # A generator is evaluated once for each row, though several columns come of it.
    counted = docs.drop(*MEASURES).select("*", F.inline(F.array(by_words)))
    return counted.withColumns(
        {
            "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast(
                "long"
            ),
            "n_dup_lines": n_dup.cast("long"),
        }
    )


def host_verdicts(
    measured: DataFrame,
    host: str = "source",
    rules: dict[str, str] | None = None,
    limit: float = HOST_RATE,
) -> DataFrame:
    """One row for each host: documents, the shrunk failure rate of each rule, the verdict.

    The prior of a rule is the beta distribution whose mean is the rate over all documents and
    whose spread is that of the hosts' rates (method of moments; a weight of 1 document at
    least, of a million if the hosts do not differ). Failures are added up before the shuffle.
    """
    rules = HOST_RULES if rules is None else rules
    failed = {r: F.sum(F.expr(c).cast("long")).alias(f"fail_{r}") for r, c in rules.items()}
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("host_docs"), *failed.values()
    )
    hosts = settle(hosts, "hosts")

    def mean(r: str) -> Column:
        return F.sum(f"fail_{r}") / F.sum("host_docs")

    overall = hosts.agg(*[mean(r).alias(f"mean_{r}") for r in rules])
    spread = hosts.join(F.broadcast(overall)).agg(
        *[F.first(f"mean_{r}").alias(f"mean_{r}") for r in rules],
        *[
            F.avg(F.pow(F.col(f"fail_{r}") / F.col("host_docs") - F.col(f"mean_{r}"), 2)).alias(
                f"var_{r}"
            )
            for r in rules
        ],
    )
    for r in rules:
        m, v = F.col(f"mean_{r}"), F.col(f"var_{r}")
        weight = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(1e6)
        spread = spread.withColumn(f"weight_{r}", weight)
    rates = {
        f"rate_{r}": (F.col(f"fail_{r}") + F.col(f"mean_{r}") * F.col(f"weight_{r}"))
        / (F.col("host_docs") + F.col(f"weight_{r}"))
        for r in rules
    }
    verdicts = hosts.join(F.broadcast(spread)).select("host", "host_docs", *_named(rates))
    worst = F.greatest(*rates, F.lit(0.0))
    return verdicts.withColumn("host_rate", worst).withColumn("host_rejected", worst >= limit)


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def apply_rules(
    measured: DataFrame, host: str = "source", rules: dict[str, str] | None = None
) -> DataFrame:
    """Measured documents with ``base_failed``, ``host_rate``, ``host_rejected``, ``kept``.

    ``measured`` should be a stored table: it is read for the hosts and for the documents. The
    hosts' verdicts are stored, so Spark knows their size when it chooses the join.
    """
    base = F.lit(False)
    for condition in BASE_RULES.values():
        base = base | F.expr(condition)
    verdicts = host_verdicts(measured, host, rules).select("host", "host_rate", "host_rejected")
    verdicts = settle(verdicts, "verdicts").withColumnRenamed("host", "verdict_host")
    out = measured.drop("host_rate", "host_rejected", "base_failed", "kept", "verdict_host")
    out = out.join(verdicts, F.col(host).eqNullSafe(F.col("verdict_host")), "left")
    out = out.drop("verdict_host").withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """All documents with their measures and verdicts; the measures are taken once and stored."""
    return apply_rules(settle(measure(docs, text), "measured"), host)
