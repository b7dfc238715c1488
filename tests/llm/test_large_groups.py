"""Large groups of near copies and very common passages: what is made grows with a group, not its square."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperlode.llm import simhash, suffixes


@pytest.fixture
def stored(monkeypatch):
    """Rows of all that the two operators store, by label."""
    found = Counter()
    for module in (simhash, suffixes):

        def counted(df, label, settle=module.settle):
            out = settle(df, label)
            found[label] += out.count()
            return out

        monkeypatch.setattr(module, "settle", counted)
    return found


def near_copies(n, changes, rng):
    """Texts of 300 words that differ from one another in ``changes`` words or twice as many."""
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = []
    for i in range(n):
        own = list(base)
        for place in rng.sample(range(4, 296), rng.choice(changes)):
            own[place] = f"own{i}x{place}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [1_000, 40])
def test_pairs_of_near_copies_are_not_listed(spark, monkeypatch, stored, block):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block, raising=False)
    rng = random.Random(7)
    n = 240
    texts = near_copies(n, (2, 3, 5, 8), rng)
    sets = [{tuple(w[k : k + 5]) for k in range(296)} for w in map(str.split, texts)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs.withColumn("n", F.lit(1)), "").collect()}
    want = {x for x in range(n) if find(x) == x}
    assert 1 < len(want) < n and want <= kept and len(kept - want) <= 0.02 * n
    assert stored["pairs"] <= n  # all pairs of two classes were 10,000 and more
    assert stored["proposed"] <= 10 * n  # was 30 and more for each text
    assert stored["across"] <= n * (1 + n // block)


def test_blocks_link_what_all_pairs_link(spark, monkeypatch):
    rng = random.Random(8)
    texts = near_copies(90, (2, 4, 6), rng) + near_copies(30, (3, 5), rng) + ["", "a"]
    hashes = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    prints = [simhash.majorities(h, 12) for h in hashes]
    threshold = simhash.differing_bits(0.8, 4, 3)
    places = [{(k, x) for k in range(12) for x in simhash.anchors(np.array(p[k : k + 1]))[0].tolist() if x >= 0} for p in prints]
    family = [0] * 90 + [1] * 30 + [2] * 2
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def linked(a, b):
        bits = np.bitwise_count((np.array(prints[a][:4]) ^ np.array(prints[b][:4])).astype(np.uint64)).sum()
        shared = len(np.intersect1d(hashes[a], hashes[b]))
        alike = shared >= 0.8 * (len(hashes[a]) + len(hashes[b]) - shared)
        return family[a] == family[b] and bits <= threshold and alike and places[a] & places[b]

    for a in range(len(texts)):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    nodes = spark.createDataFrame([(i, i, f, p) for i, (f, p) in enumerate(zip(family, prints))], "node long, class long, family long, prints array<long>")
    sets = spark.createDataFrame([(i, h.view(np.int64).tolist()) for i, h in enumerate(hashes)], "node long, hashes array<long>")
    for texts_, hashes_ in ((1_000, 500_000), (7, 500_000), (1_000, 3_000)):
        monkeypatch.setattr(simhash, "BLOCK_TEXTS", texts_)
        monkeypatch.setattr(simhash, "BLOCK_HASHES", hashes_)
        links = simhash.links_across(nodes, sets, threshold, 0.8)
        got = dict(map(tuple, simhash.components(links).collect()))
        assert got == {x: find(x) for x in range(len(texts)) if find(x) != x}


def test_common_passages_leave_few_suffixes_to_compare(spark, monkeypatch, stored):
    monkeypatch.setattr(suffixes, "ROWS", 30)  # so that grams and cells go over several buckets
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(rng.choices(letters, k=420))
    texts = []
    for i in range(300):
        a, b = (rng.randrange(0, 60), rng.randrange(360, 420)) if i % 3 else (0, 420)
        texts.append("".join(rng.choices(letters, k=rng.randrange(0, 200))) + passage[a:b] + "".join(rng.choices(letters, k=rng.randrange(0, 200))))
    texts += texts[:5] + [passage, passage[:250], passage[:199], "", None]
    count = Counter(t[i : i + 200] for t in texts if t for i in range(len(t) - 199))
    want = []
    for t in texts:
        gone = np.zeros(len(t or ""), dtype=bool)
        for i in range(len(gone) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want.append(np.frombuffer((t or "").encode(), np.uint8)[~gone].tobytes())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_repeats(docs).collect()}
    assert got == dict(enumerate(want))
    assert stored["anchors"] > 1_000
    assert stored["buckets"] <= 14 * stored["anchors"]  # 50 for each when all suffixes of a gram met


def test_counts_of_cells_settle_most_of_them(spark, stored):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(rng.choices(letters, k=420))
    texts = ["".join(rng.choices(letters, k=150)) + passage + "".join(rng.choices(letters, k=150)) for _ in range(200)]
    texts += [texts[0]] * 20 + [texts[1][40:], passage + passage, None]
    count = Counter(t[i : i + 200] for t in texts if t for i in range(len(t) - 199))
    want = []
    for t in texts:
        gone = np.zeros(len(t or ""), dtype=bool)
        for i in range(len(gone) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want.append(np.frombuffer((t or "").encode(), np.uint8)[~gone].tobytes())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_repeats(docs).collect()}
    assert got == dict(enumerate(want))
    assert stored["anchors"] > 1_000
    assert stored["cut"] <= 2 * stored["anchors"]  # all cells of all contexts were cut, sent and sorted
