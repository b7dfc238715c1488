import math
from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from paperlode.functions import resources as rs, text as tx, vectors as vec


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_titles_urls_and_text(spark):
    assert one(spark, tx.title_with_id(F.col("i"), F.col("t")), i="2001.1", t="On A") == "[2001.1] On A"
    assert one(spark, tx.paper_url(F.col("i"), "pdf"), i="7") == "https://arxiv.org/pdf/7.pdf"
    assert one(spark, tx.paper_url(F.col("i"), "www"), i="7") == "https://www.arxiv.org/abs/7"
    assert one(spark, tx.doc_text(F.col("t"), F.lit(None).cast("string")), t="a") == "a "


def test_years(spark):
    for text, year in [("2020-01-01", 2020), ("2020-13-01", 1900), ("soon", 1900), (None, 1900)]:
        assert one(spark, tx.year_or_default(F.lit(text).cast("string"))) == year


def test_url_parts(spark):
    cases = {
        "https://dblp.org/db/conf/icse/icse2015.html": (2015, "ICSE"),
        "https://dblp.org/db/conf/kbse/ase2020.html": (2020, "KBSE"),
        "https://example.org/list2001.html": (2001, "UNKNOWN"),
        "https://example.org/none.html": (None, "UNKNOWN"),
    }
    for url, (year, venue) in cases.items():
        assert one(spark, tx.url_year(F.col("u")), u=url) == year
        assert one(spark, tx.url_venue(F.col("u")), u=url) == venue


def test_author_strings(spark):
    df = spark.createDataFrame(
        [([["Doe", "Jane", ""]],), ([["Roe", "Al", "Jr"], ["Bo", "C", ""]],), ([],)], "a ARRAY<ARRAY<STRING>>"
    )
    got = [r[0] for r in df.select(tx.author_string(F.col("a"))).collect()]
    assert got == ["Jane Doe", "Jr Al Roe, C Bo", ""]
    assert one(spark, tx.join_names(F.array(F.lit(" A B\n"), F.lit("C ")))) == "A B, C"


def test_query_helpers(spark):
    assert one(spark, tx.query_text(F.col("q")), q="a, b ,c") == "a b c"
    assert one(spark, tx.safe_name(F.col("q")), q="Big Models") == "big_models"
    for text in ["proof-of-concept o'neil  x1y", "straße ßa", "ABC déjà", ""]:
        assert one(spark, tx.title_case(F.col("q")), q=text) == text.title()


def test_plural_stem(spark):
    for term, stem in {
        "queries": "query", "zombies": "zomby", "eies": "eies", "shoes": "shoes", "trees": "trees",
        "classes": "classe", "cats": "cat", "bus": "bus", "glass": "glass", "es": "es", "gas": "ga",
    }.items():
        assert one(spark, tx.plural_stem(F.col("t")), t=term) == stem, term


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=2), max_size=12), min_size=1, max_size=6))
def test_counted_is_a_counter(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "w ARRAY<STRING>")
    for row in df.select("w", tx.counted(F.col("w")).alias("c")).collect():
        assert {c["term"]: c["tf"] for c in row["c"]} == dict(Counter(row["w"]))


def test_terms(spark):
    assert one(spark, tx.terms(F.col("t")), t="The x-ray, Über_1 a b2!") == ["the", "ray", "über_1", "b2"]
    assert one(spark, tx.terms(F.lit(None).cast("string"))) == []


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vec.dot(a, b)) == 8.0
    assert one(spark, vec.cosine(a, b)) == 0.8
    assert one(spark, vec.cosine(a, zero)) == 0.0
    assert one(spark, vec.l2sq(a, b)) == 13.0
    assert one(spark, vec.l2_normalize(a)) == [0.6, 0.8]
    assert one(spark, vec.l2_normalize(zero)) == [0.0, 0.0]
    assert one(spark, vec.relevance(F.lit(2.0))) == 1 - 2 / math.sqrt(2)


def test_resources(spark):
    assert one(spark, rs.resource_map(F.col("t")), t="cpu=4, mem = 2G,junk,a=b=c,cpu=5") == {
        "mem": "2G", "a": "b=c", "cpu": "5"
    }
    for text, mb in {"2G": 2048, "512m": 512, "7": 7, "1.5G": None}.items():
        assert one(spark, rs.mem_mb(F.col("t")), t=text) == mb
    assert one(spark, rs.tex_score(F.col("t")), t=r"\section \begin{a} \cite{x} \cites \sec") == 4
