"""Benchmark windows in documents against a plain search."""

import hashlib
import random
import re

import pytest

from paperlode.llm import leaks, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORKING = "spans string, items string, n_hit string, i string, t string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(texts, items, window=10):
    """(n_words, hit places, item ids) of each text."""
    grams = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    for text in texts:
        w = WORD.findall(lowered(text))
        hit, ids = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    ids |= grams[tuple(w[i : i + n])]
        yield len(w), hit, ids


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("ab c1 é Ö ß the of ünder 7 日本 x_y".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(25)]
    items += [(30, "short one"), (31, "Short-ONE"), (32, ""), (33, None), (34, " .,"), (30, "another text of id thirty")]
    items += [(None, "row without an id"), (35, items[0][1]), (36, "w" * 500 + " end")]
    items.append((37, " ".join(f"q{k % 977}" for k in range(9_000))))  # several segments
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"pre {i}, {items[i][1].upper()}! post {items[i + 1][1][:40]}") for i in range(12)]
    docs += [(200, None), (201, ""), (202, "--- ..."), (203, "a short one, ONE SHORT: short one")]
    docs += [(204, "see row without an id here"), (205, "w" * 500 + " end"), (206, "w" * 499 + " end"), (205, "w" * 500 + " end")]
    docs.append((207, " ".join(f"q{k % 977}" for k in range(4_000, 4_300))))
    docs.append((208, ("z" * 70 + " ") * 30_000 + items[3][1]))
    rows = [(i, t, "s", "i", 4, "x", None) for i, t in docs]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, spans string, items string, n_hit long, i string, t string")
    return docs, items, frame.repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [leaks.BLOCK, 2_000])
def test_hits_equal_a_plain_search(tables, monkeypatch, block):
    docs, items, frame, bench = tables
    monkeypatch.setattr(leaks, "BLOCK", block)
    found = leaks.find_leaks(frame, bench)
    assert {"doc_id", "i", "t"} <= set(found.columns) and len(found.columns) == len(set(found.columns))
    want = {i: r for (i, _), r in zip(docs, plain([t for _, t in docs], items))}
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, ids = want[r["doc_id"]]
        assert r["n_words"] == n and r["n_hit"] == len(hit)
        assert {j for s in r["spans"] for j in range(s["start"], s["end"])} == hit
        assert sorted(r["items"], key=str) == sorted((None if i is None else str(i) for i in ids), key=str)


def test_spans_and_documents_go(tables):
    docs, items, frame, bench = tables
    found = leaks.find_leaks(frame, bench)
    cut = {r["doc_id"]: r["text"] for r in leaks.without_spans(found).collect()}
    for (i, text), (n, hit, _) in zip(docs, plain([t for _, t in docs], items)):
        kept = [w for j, w in enumerate(WORD.findall(lowered(text))) if j not in hit]
        assert WORD.findall(lowered(cut[i])) == kept
        if not hit:
            assert cut[i] == text
    left = leaks.without_documents(found).collect()
    clean = [i for (i, _), (_, hit, _) in zip(docs, plain([t for _, t in docs], items)) if not hit]
    assert sorted(r["doc_id"] for r in left) == sorted(clean)


def test_empty_tables(spark, tables):
    _, _, frame, bench = tables
    none = leaks.find_leaks(frame, bench.limit(0)).collect()
    assert len(none) == frame.count() and not any(r["n_hit"] or r["items"] for r in none)
    assert any(r["n_words"] for r in none)
    assert leaks.find_leaks(frame.limit(0), bench).count() == 0


def test_segments_keep_all_windows():
    words = [f"w{k}" for k in range(3 * leaks.SEGMENT + 5)]
    whole = {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
    parts = list(leaks.segments([("a", " ".join(words))], 10))
    assert len(parts) > 2 and all(len(p) < leaks.SEGMENT + 10 for _, p in parts)
    found = {tuple(w.decode() for w in p[i : i + 10]) for _, p in parts for i in range(len(p) - 9)}
    assert found == whole


def test_query_digest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {d["doc_id"]: r for d, r in zip(docs, plain([d["text"] for d in docs], items))}
    got = queries.QUERIES["op11_benchmark_leaks"](spark, sf_dir).collect()
    assert len(got) == len(docs) and any(r["contaminated"] for r in got)
    for r in got:
        n, hit, ids = want[r["doc_id"]]
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, len(hit), len(ids), digest)
