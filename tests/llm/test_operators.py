"""Operators against brute-force versions, with nulls, empty texts, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperlode.llm import bpe, licenses, mixing, quality, shards, simhash, suffixes, toxicity, urls, vectors
from paperlode.llm.components import components
from paperlode.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choice("alpha beta gamma delta".split()) + str(i) for i in range(60))
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(80)), "s1", "x") for i in range(30)]
    rows += [(100 + i, f"start {i} {passage} end {i}", "s1", "x") for i in range(12)]
    rows += [(200 + i, passage, "s2", "x") for i in range(9)] + [(200, passage, "s2", "x")]
    rows += [(300, None, None, None), (301, "", "s3", "x"), (None, "a b\na b\na b #", "s3", "x")]
    rows += [(302, "é" * 5000, "s4", "x"), (303, "q" * 200, "s4", "x"), (304, "q" * 199, None, "x")]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_quality_measures(docs):
    got = quality.measure(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        w = WORD.findall(r["text"] or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_repeat_words"] == len(hit)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in r["text"] or "")


def test_quality_host_verdicts(spark):
    rows = [(i, "x " * 10, "bad", None) for i in range(40)]
    rows += [(i, " ".join(f"w{k}" for k in range(60)), "good", None) for i in range(100, 160)]
    out = quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["source"]: r["host_rejected"] for r in out} == {"bad": True, "good": False}
    assert all(r["kept"] for r in out if r["source"] == "good")
    assert quality.quality_rules(spark.createDataFrame([], DOCS)).collect() == []


def test_shards(spark, docs):
    for n in (1, 2, 7, 10, 97):
        place = shards.permuted(F.col("id"), n)
        assert sorted(r[0] for r in spark.range(n).select(place).collect()) == list(range(n))
    rows = shards.shard_rows(docs, [F.col("doc_id"), F.xxhash64("text")], 7).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert shards.shard_rows(docs.limit(0), [F.col("doc_id")], 7).collect() == []


def test_mix(docs):
    mixed = mixing.mix(docs, keep_text=True).cache()
    rows = mixed.collect()
    total = sum(r["size"] for r in rows)
    goals = {r["source"]: r["target"] for r in rows}
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(WORD.findall(r["text"] or ""))
        taken[r["source"]] += r["taken"]
    assert sum(goals.values()) == pytest.approx(1.5 * total)
    assert all(taken[s] == int(goals[s]) for s in goals)
    dealt = mixing.dealt(mixed).collect()
    assert sum(len(WORD.findall(r["text"])) for r in dealt) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).collect() == []


def test_licenses(spark):
    mit = "Released under the MIT License."
    rows = [
        ("a/LICENSE", mit), ("a/x", "nothing here"), ("a/b/c/y", None), ("z", ""),
        ("a/b/w", "code\nLicensed under the Apache License, Version 2.0.\nmore"), (None, "text"), ("a/x", "nothing here"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    found = {r["path"]: (r["license"], r["origin"], r["license_dir"]) for r in got}
    assert len(got) == len(rows)
    assert found["a/x"] == ("MIT", "inherited", "a") == found["a/b/c/y"]
    assert found["a/b/w"] == ("Apache-2.0", "own", None)
    assert found["z"] == (None, "none", None) == found[None]


def test_license_headers_do_not_depend_on_corpus_size_or_neighbours(spark):
    headers = [
        "Released under the MIT License by Acme", "This file is Released under the\n * MIT License.",
        "Released by Acme under the MIT License", "x " * 300 + "Released under the MIT License " + "y " * 300,
    ]
    for n in (200, 4000):
        rows = [(f"h/{i}", h) for i, h in enumerate(headers)]
        rows += [(f"m/{i}", "Released under the MIT License.") for i in range(n // 20)]
        rows += [(f"t/{i}", f"this file is plain text number{i} of the day") for i in range(n)]
        got = licenses.scan(spark.createDataFrame(rows, "path string, text string"))
        found = {r["path"]: r["license"] for r in got.collect()}
        assert [found[f"h/{i}"] for i in range(4)] == ["MIT"] * 4
        assert all(v == "MIT" if p[0] in "hm" else v is None for p, v in found.items())


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root if find(x) != x}


def test_near_links_keep_all_connections(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)}
    prints |= {rng.getrandbits(64) for _ in range(300)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    table = spark.createDataFrame([(x,) for x in signed], "print long")
    bits = np.array(signed, dtype=np.int64).astype(np.uint64)
    root = list(range(len(signed)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(signed)):
        for j in np.nonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= 3)[0]:
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    want = {signed[i]: signed[find(i)] for i in range(len(signed)) if find(i) != i}
    for limit in (20_000, 20):  # the second deals crowded anchors out anew
        got = dict(map(tuple, components(simhash.near_links(table, limit=limit)).collect()))
        assert got == want


def test_tuple_links_keep_all_connections(spark):
    rng = np.random.default_rng(8)
    centre = rng.integers(-(2**63), 2**63, (3, 2))
    flips = np.packbits(rng.random((500, 128)) < 0.06, axis=1).view(np.int64)
    prints = np.unique(np.concatenate([centre[rng.integers(0, 3, 500)] ^ flips, centre]), axis=0)
    nodes = simhash.node_of(prints).tolist()
    places = np.concatenate([simhash.anchors(prints[:, k]) for k in range(2)], axis=1).tolist()
    keys = [{(j // 32, key) for j, key in enumerate(row) if key >= 0} for row in places]
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(nodes)):
        near = np.bitwise_count((prints[i + 1 :] ^ prints[i]).view(np.uint64)).sum(axis=1) <= 16
        for j in i + 1 + np.nonzero(near)[0]:
            if keys[i] & keys[j]:
                a, b = sorted((find(nodes[i]), find(nodes[j])))
                root[b] = a
    want = {x: find(x) for x in nodes if find(x) != x}
    rows = [(x, p) for x, p in zip(nodes, prints.tolist())]
    table = spark.createDataFrame(rows, "node long, prints array<long>")
    for limit in (20_000, 15):  # the second compares blocks of crowded anchors
        links = simhash.tuple_links(table, 2, 16, limit)
        assert dict(map(tuple, components(links).collect())) == want


def test_near_duplicates_of_similarity(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    rows, n = [], 120
    for i in range(n):
        body = rng.choices(words, k=400)
        other = list(body)
        for place in rng.sample(range(400), 6):  # 30 of 396 windows each way: similarity 0.86
            other[place] = "new"
        far = body[:200] + rng.choices(words, k=200)  # a third
        rows += [(3 * i, " ".join(body)), (3 * i + 1, " ".join(other)), (3 * i + 2, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(docs, prints=4).collect()}
    assert all(3 * i in kept and 3 * i + 2 in kept for i in range(n))
    assert sum(3 * i + 1 not in kept for i in range(n)) >= 0.85 * n


def test_pipeline_near_duplicates_are_exact(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    rows, sets = [], []
    for i in range(150):
        body = rng.choices(words, k=300)
        for changes in (0, 6, 9):  # similarity 0.82 to the first, then 0.74 or so
            other = list(body)
            for j in range(changes):
                other[5 + 30 * j] = f"new{changes}"
            rows.append((len(rows), " ".join(other)))
            sets.append({tuple(other[k : k + 5]) for k in range(296)})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a - a % 3, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[a] = min(root[a], root[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs.withColumn("n", F.lit(1)), "").collect()}
    want = {a for a in root if root[a] == a}
    assert want <= kept  # nothing below 0.8 goes
    assert len(kept - want) <= 3  # and 0.98 of the links at 0.8 are found


def test_near_classes_and_one_of_each(docs):
    prints = docs.withColumn("prints", simhash.fingerprints(F.col("text")))
    rows = by_id(simhash.near_classes(prints).collect())
    assert {r["component_id"] for i in range(200, 209) for r in rows[i]} == {200}
    assert rows[300][0]["component_id"] == rows[301][0]["component_id"] == 300
    kept = [r["doc_id"] for r in simhash.one_of_each(docs, prints=2).collect()]
    assert sum(200 <= (i or 0) < 300 for i in kept) <= 1
    assert any(100 <= (i or 0) < 300 for i in kept) and sum((i or 300) < 30 for i in kept) >= 29
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def removed(texts):
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
    return out


def test_suffixes(docs):
    rows = docs.collect()
    want = removed([(r["text"] or "").encode() for r in rows])
    got = suffixes.remove_repeats(docs).collect()
    key = lambda r, kept: (r["doc_id"] is None, r["doc_id"] or 0, bytes(kept))
    assert sorted(key(r, w) for r, w in zip(rows, want)) == sorted(key(r, r["kept"]) for r in got)
    assert all(
        len((r["text"] or "").encode()) - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["removed"])
        for r in got
    )
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []


def test_suffix_bucket_cut_inside_a_token(monkeypatch):
    rng = random.Random(4)
    gram = bytes(rng.choices(b"abcdefgh", k=64))
    tail = bytes(rng.choices(b"abcdefgh", k=136))
    bodies = [bytes(rng.choices(b"xyz", k=100)) + b"c" * 36 + gram + tail for _ in range(9)]
    table = pa.RecordBatch.from_pydict(
        {"h": [1] * 9, "k1": list(range(9)), "k2": [0] * 9, "pos": [136] * 9, "single": [True] * 9, "body": bodies}
    )
    monkeypatch.setattr(suffixes, "ROWS", 1)
    rows = [r for b in suffixes._bucket([table]) for r in b.to_pylist()]
    groups = {}
    for r in rows:
        if r["kind"]:
            groups.setdefault((r["t1"], r["t2"]), []).append(r)
    ends = [x for g in groups.values() if len(g) > 1 for x in g]
    assert {r["k1"] for r in ends} == set(range(9))
    assert {r["a"] for r in ends} >= set(range(100, 137))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 12)) * rng.uniform(0.5, 2, (400, 1))
    x[20:90] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0]), (None, x[0].tolist()), (1080, [None] * 12)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = vectors.search(table, F.col("vec_id") % 20 == 0, 5, probed=1.0).toPandas()
    assert set(got.query_id) == set(range(0, 400, 20)) and (got.groupby("query_id").size() == 5).all()
    hit = 0
    for q, part in got.groupby("query_id"):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -score))[:5]
        hit += len(set(best) & set(part.vec_id))
        assert np.allclose(part.sort_values("rank").score, (x[part.sort_values("rank").vec_id] * x[q]).sum(axis=1))
    assert hit >= 0.9 * len(got)
    same = got[got.query_id == 20].sort_values("rank")
    assert same.vec_id.is_monotonic_increasing or same.score.nunique() > 1
    assert vectors.search(table.limit(0), F.lit(True)).collect() == []


def test_url_cascade(spark):
    hosts = ["a.com", "example.com", "www.example.com", "x.net", "b.example.org", "notcom", "com"]
    rows = [(i, f"HTTP://{h.upper()}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/", "/en/1", "/es/2?x", "/fr/#y"))]
    rows += [(900, None), (901, "no scheme"), (902, "://")] + rows[:3]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("keys", F.lit("own"))
    got = urls.filter_urls(pages.withColumn("Rule", F.lit("old")), URL_RULES).collect()
    assert len(got) == len(rows) and {r["keys"] for r in got} == {"own"}
    for r in got:
        fits = [
            (len(k), k, a) for a, k in URL_RULES
            if ("." + r["host"]).endswith("." + k.split("/", 1)[0]) and r["path"].startswith("/" + k.split("/", 1)[1])
        ]
        best = max(fits, default=(0, None, "allow"))
        assert (r["rule"], r["verdict"]) == best[1:]


def test_bpe(docs):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(path)
    rng = random.Random(3)
    texts = ["a" * 3000, "".join(rng.choice("abé ") for _ in range(5000)), "it's\x1c\x85  x  \n\n y", "<|endoftext|>"]
    texts += ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0xD7FF)])) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode_ordinary(t)
    encoded = bpe.encode(docs).withColumn("back", bpe.decode(F.col("ids")))
    texts = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect())
    assert sorted(hashlib.sha256(r["back"]).hexdigest() for r in encoded.collect()) == texts


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["the", "house", "river", "garden", "blue", "window", "paper", "stone"]
    rows = []
    for i in range(240):
        w = rng.choices(plain, k=30)
        if i % 3 == 0:
            w[rng.randrange(30)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit(*toxicity.training_sample(table, table.select("doc_id", "y")))
    clean = " ".join(rng.choices(plain, k=29))
    bad = ["idiot", "idiiot", "idi-ot", "i d i o t", "moron###", "mor.on"]
    tests = [f"{clean} {w}" for w in bad] + [clean, clean + " stone", "", None, "stone " * 500]
    asked = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    score = [r["score"] for r in sorted(toxicity.score(asked, model).collect())]
    assert min(score[: len(bad)]) >= 0.3 > max(score[len(bad) :]), score
    none = toxicity.fit(*toxicity.training_sample(table.limit(0), table.select("doc_id", "y").limit(0)))
    assert [r["score"] for r in toxicity.score(asked.limit(1), none).collect()] == [0.0]
