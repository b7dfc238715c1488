from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperlode import schemas
from paperlode.functions.resources import resource_map
from paperlode.operators import aggregates, crawl
from paperlode.operators.filters import fully_free
from paperlode.sources import bibtex, html, records, sinks, tables


def test_jsonl_tree_skips_empty_files_and_blank_lines(spark, tmp_path):
    (tmp_path / "icse").mkdir()
    (tmp_path / "icse/2000.json").write_text('{"year":2000,"venue":"ICSE","title":"T","dblp_id":"a"}\n\n{"dblp_id":"b"}\n')
    (tmp_path / "icse/2001.json").write_text("")
    got = tables.read_jsonl_tree(spark, str(tmp_path), schemas.LISTING)
    assert sorted(r["dblp_id"] for r in got.collect()) == ["a", "b"]
    assert got.columns == ["year", "venue", "title", "dblp_id", "authors"]


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text(
        "% a comment {x}\n"
        '@inproceedings{doe-2024-a,\n  title = "On {A}",\n  author = "Doe, Jane and Roe, Al",\n'
        '  year = "2024",\n  url = "https://example.org/a"\n}\n'
        "@comment{ignored, x = 1}\n"
        "   @article{roe-2023-b,\n  title = {B {deep {nested {value}}} here},\n  year = {2023}, month = jun\n}"
    )
    entries = bibtex.entry_columns(bibtex.read_bibtex(spark, str(tmp_path)), schemas.ANTHOLOGY_FIELDS)
    got = {r["ID"]: r for r in entries.collect()}
    assert set(got) == {"doe-2024-a", "roe-2023-b"}
    a, b = got["doe-2024-a"], got["roe-2023-b"]
    assert (a["ENTRYTYPE"], a["title"], a["author"], a["year"]) == ("inproceedings", "On {A}", "Doe, Jane and Roe, Al", "2024")
    assert a["url"] == "https://example.org/a" and a["abstract"] is None
    assert (b["ENTRYTYPE"], b["title"], b["year"], b["month"]) == ("article", "B {deep {nested {value}}} here", "2023", "jun")


def test_bibtex_braces_of_any_depth(spark, tmp_path):
    deep = {f"d-{n}": "{" * n + "x" + "}" * n for n in (0, 6, 7, 12, 300)}
    entries = [f"@misc{{{key},\n title = {{{value}}},\n year = 2020\n}}" for key, value in deep.items()]
    (tmp_path / "a.bib").write_text("\n".join(entries))
    found = bibtex.entry_columns(bibtex.read_bibtex(spark, str(tmp_path)), ["title", "year"]).collect()
    assert {r["ID"]: r["title"] for r in found} == deep and {r["year"] for r in found} == {"2020"}


LISTING = """<html><ul><li class="entry inproceedings" id="conf/x/A1"><span itemprop="name">Jane Doe</span>,
<span itemprop="name">Al Roe</span><span class="title"> On <i>A</i> &amp; B. </span></li>
<li class="entry editor" id="conf/x"><span itemprop="name">Ed Itor</span><span class="title">Proc.</span></li>
<li class="entry inproceedings"><span itemprop="name">B B</span><span class="title">No id.</span></li>
<li class="entry inproceedings" id="conf/x/A3"></li></ul></html>"""


def test_listing(spark):
    pages = spark.createDataFrame(
        [(1, "https://dblp.org/db/conf/icse/icse2015.html", LISTING), (2, "https://example.org/none.html", "<p>x</p>")],
        "page_id LONG, url STRING, html STRING",
    )
    got = sorted(map(tuple, html.extract_listing(pages).collect()))
    hashed = spark.range(1).select(F.sha2(F.lit("No id."), 256)).first()[0]
    assert got == sorted(
        [
            (2015, "ICSE", "On A & B.", "conf/x/A1", "Jane Doe, Al Roe"),
            (2015, "ICSE", "No id.", hashed, "B B"),
            (2015, "ICSE", "", "conf/x/A3", ""),
        ]
    )


def test_titles_keep_inner_elements(spark):
    title = '<span class="title">On <span class="sub">x <span>y</span></span> and z.</span>'
    rows = [
        (1, f'<li class="entry inproceedings" id="a">{title}</li>'),
        (2, '<li class="entry inproceedings" id="b"><span class="title">Not <span>paired.</span></li>'),
    ]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id LONG, url STRING, html STRING")
    got = {r["dblp_id"]: r["title"] for r in html.extract_listing(pages).collect()}
    assert got == {"a": "On x y and z.", "b": "Not paired."}
    page = f'<li itemtype="http://schema.org/ScholarlyArticle">{title}</li>'
    pages = spark.createDataFrame([(1, "u", page)], "page_id LONG, url STRING, html STRING")
    assert html.extract_author_page(pages).first()["title"] == "On x y and z."


def test_author_page(spark):
    page = """<ul><li class="entry" itemscope itemtype="http://schema.org/ScholarlyArticle">
    <span itemprop="name">A One</span><span class="title">T1.</span>
    <span itemprop="isPartOf"><span itemprop="name">ICSE</span></span><span itemprop="datePublished">2020</span></li></ul>"""
    pages = spark.createDataFrame([(1, "u", page)], "page_id LONG, url STRING, html STRING")
    assert list(map(tuple, html.extract_author_page(pages).collect())) == [("T1.", "A One, ICSE", "ICSE", "2020")]


def test_node_records(spark, tmp_path):
    (tmp_path / "n.txt").write_text(
        "header k=v\nNodeName=a1 CfgTRES=cpu=4,mem=2G\n  AllocTRES=cpu=1\n"
        "NodeName=a2 CfgTRES=cpu=4,mem=2G AllocTRES=cpu=4,mem=1G\n"
        "NodeName=a3 CfgTRES= AllocTRES=\nNodeName=a4 CfgTRES=cpu=1 X=1 X=2\n"
    )
    (tmp_path / "m.txt").write_text("NodeName=b1 CfgTRES=cpu=2 AllocTRES=cpu=1\n")
    got = records.read_kv_records(spark, str(tmp_path))
    by_name = {r["fields"]["NodeName"]: r["fields"] for r in got.collect()}
    assert set(by_name) == {"a1", "a2", "a3", "a4", "b1"}
    assert by_name["a4"]["X"] == "2"
    nodes = got.select(
        F.col("fields")["NodeName"].alias("node"),
        resource_map(F.try_element_at("fields", F.lit("CfgTRES"))).alias("cfg"),
        resource_map(F.try_element_at("fields", F.lit("AllocTRES"))).alias("alloc"),
    )
    assert sorted(r["node"] for r in fully_free(nodes, "cfg", "alloc").collect()) == ["a1", "a4", "b1"]


def test_main_tex(spark, tmp_path):
    for name, text in {
        "p1/main.tex": b"\\begin{document} \\section \\cite \xff",
        "p1/sub/other.tex": b"\\begin{document}",
        "p2/part.tex": b"\\section",
        "p1/notes.txt": b"\\begin{document} \\cite \\cite \\cite \\cite",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text)
    files = records.read_tex_files(spark, str(tmp_path))
    texts = {(r["paper_id"], Path(r["path"]).name): r["text"] for r in files.collect()}
    assert texts[("p1", "main.tex")] == "\\begin{document} \\section \\cite "
    best = aggregates.main_tex(files).collect()
    assert [(r["paper_id"], Path(r["path"]).name) for r in best] == [("p1", "main.tex")]
    assert [r["paper_id"] for r in aggregates.papers_without_main_tex(files).collect()] == ["p2"]


def test_snapshot_and_append(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id INT, v STRING")
    path = sinks.write_snapshot(a, str(tmp_path), datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("2024-01-02-03-04-05.json")
    table = str(tmp_path / "t")
    for _ in range(2):
        sinks.append_new(a, table, "id", "v")
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "x"), (2, "z")]


def test_replace_table(spark, tmp_path):
    name = "papers_replaced"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (id INT) USING parquet LOCATION '{tmp_path}/t'")
    for ids in ([1, 2], [3]):
        sinks.replace_table(spark.createDataFrame([(i,) for i in ids], "id INT"), name)
        assert sorted(r[0] for r in spark.table(name).collect()) == ids
    spark.sql(f"DROP TABLE {name}")


def test_due_pages(spark, tmp_path):
    for name, size in {"icse/2000": 5120, "icse/2001": 5121, "icse/2002": 0}.items():
        path = tmp_path / f"{name}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b" " * size)
    patterns = crawl.venue_patterns(spark).filter("venue = 'icse'")
    due = crawl.due_pages(crawl.frontier(patterns, 2000, 2003), crawl.stored_listings(spark, str(tmp_path)))
    assert sorted({r["year"] for r in due.collect()}) == [2000, 2002, 2003]
    assert crawl.frontier(crawl.venue_patterns(spark)).count() == 30 * 25


def test_load_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.load_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1


def test_load_counts(spark):
    df, seen = aggregates.load_counts(spark.range(7), "load")
    df.collect()
    assert seen.get == {"rows": 7}


def test_unknown_names_are_errors(spark):
    from paperlode.plans.align import align

    with pytest.raises(ValueError):
        align(spark.range(1), "other")
    with pytest.raises(ValueError):
        aggregates.pool(spark.range(1), "id", "max")
