"""Columns that have the names of working columns, long hosts, and licenses of near relatives."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperlode.llm import bpe, licenses, mixing, shards, simhash, suffixes, toxicity, urls
from paperlode.llm.common import numbered

WORKING = (
    "part start place number_ at tie row rows shard_ plan_source plan_part plan_start mix_key mix_at mix_part "
    "dir above dir_license speaks here passages others node root class_print print_ prints_ id hashes "
    "k1 k2 stretches keys found hit times own_ident_id ident_id described one y x ids_ state"
).split()


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab cd ef gh".split()) + str(rng.randint(0, 40)) for _ in range(60)), f"s{i % 3}", f"a/b{i % 4}/f{i}") for i in range(40)]
    rows += [(100, rows[0][1], None, "a/LICENSE"), (None, None, "s1", None), (101, "", "s1", "LICENSE")]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    return base.withColumns({c: F.lit(f"<{c}>") for c in WORKING}).repartition(4).cache()


def same(out, wide):
    assert len(out.columns) == len(set(c.lower() for c in out.columns))
    rows = out.collect()
    kept = [c for c in WORKING if c in out.columns]
    assert set(kept) == set(WORKING) and all(r[c] == f"<{c}>" for r in rows for c in kept)
    return rows


def test_working_names_do_not_clash(wide):
    n = wide.count()
    rows, count = numbered(wide, [F.col("doc_id")])
    assert count == n and sorted(r["number"] for r in same(rows, wide)) == list(range(n))
    placed = same(shards.shard_rows(wide, [F.col("doc_id"), F.col("text")], 5), wide)
    assert len({(r["shard"], r["slot"]) for r in placed}) == n
    mixed = same(mixing.mix(wide, keep_text=True), wide)
    assert len(mixed) == n and sum(r["taken"] for r in mixed) > 0
    assert same(mixing.dealt(mixing.mix(wide, keep_text=True)), wide)
    assert len(same(licenses.scan(wide), wide)) == n
    prints = wide.withColumn("prints", simhash.fingerprints(F.col("text"))).withColumn("component_id", F.lit("old"))
    assert len(same(simhash.near_classes(prints), wide)) == n
    assert len(same(simhash.one_of_each(wide, prints=2), wide)) == n - 2
    assert len(same(suffixes.remove_repeats(wide), wide)) == n
    assert len(same(bpe.encode(wide).drop("ids"), wide)) == n
    model = toxicity.Model(["\x03"], *[None] * 4, 0.0, 0.0, constant=0.5)
    assert len(same(toxicity.score(wide, model), wide)) == n
    found = urls.filter_urls(wide.withColumn("url", F.lit("http://a.com/x")), [("block", "com/")])
    assert {r["verdict"] for r in same(found, wide)} == {"block"}


def test_hosts_of_very_many_labels(spark):
    hosts = ["x." * 8_000 + "example.com", "a." * 20_000 + "net", "com", ".".join(["com"] * 3_000)]
    pages = spark.createDataFrame([(f"http://{h}/en/p",) for h in hosts], "url string")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("block", "net/en/")]
    begin = time.time()
    got = [r["rule"] for r in urls.filter_urls(pages, rules).collect()]
    assert got == ["example.com/en/", "net/en/", "com/", "com/"] and time.time() - begin < 30


def test_feistel_equals_plain_numbers(spark):
    """Shard and slot follow from the row number, the number of rows and the seed alone."""
    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def chain(values):
        h = 42
        for v, size in values:
            h = xxhash.xxh64_intdigest((v & ((1 << 8 * size) - 1)).to_bytes(size, "little"), h)
        return signed(h)

    def place(x, rows, seed):
        side = max(1, math.isqrt(max(rows - 1, 0)) + 1)
        while True:
            a, b = divmod(x, side)
            for k in range(shards.ROUNDS):
                a, b = b, (a + chain([(seed, 4), (k, 4), (b, 8)]) % side) % side
            x = a * side + b
            if x < rows:
                return x

    docs = spark.createDataFrame([(i, "t" * (i % 7)) for i in range(333)], "doc_id long, text string").repartition(6)
    got = shards.shard_rows(docs, [F.col("doc_id")], 24, seed=5).collect()
    for r in got:
        at = place(r["doc_id"], 333, 5)
        assert (r["number"], r["shard"], r["slot"]) == (r["doc_id"], at % 24, at // 24)


FILES = {
    "lgpl/COPYING": ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    "agpl/LICENSE": ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\nThe GNU Affero General Public License is a free, copyleft license for software and other kinds of works."),
    "gpl/COPYING": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nThe GNU General Public License is a free, copyleft license for software and other kinds of works."),
    "bsd2/LICENSE": ("BSD-2-Clause", "Copyright (c) 2020, Someone\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice."),
    "bsd3/LICENSE": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n3. Neither the name of Acme Labs nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "mpl/LICENSE": ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n1. Definitions"),
    "isc/LICENSE": ("ISC", "Copyright 2021 Someone\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED AS IS"),
    "no/readme": (None, "This is not released under the MIT License, whatever others say."),
    "never/readme": (None, "It was never Released under the MIT License"),
    "mit/readme": ("MIT", "Released under the MIT License. It is not for sale."),
    "sa/readme": ("CC-BY-SA-4.0", "Text: Licensed under CC BY-SA 4.0"),
    "by/readme": ("CC-BY-4.0", "Text: Licensed under CC BY 4.0"),
    "lgpl/src/a.c": ("LGPL-3.0", "int main;"),
    "isc/x/y/z.c": ("ISC", None),
}


def test_relatives_and_negations(spark):
    rng = random.Random(1)
    rows = [(p, t) for p, (_, t) in FILES.items()]
    rows += [(f"free/{i}", " ".join(f"w{rng.randint(0, 500)}" for _ in range(80))) for i in range(300)]
    got = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[p] for p in FILES} == {p: want for p, (want, _) in FILES.items()}
    assert {v for p, v in got.items() if p.startswith("free/")} == {None}


def plain_best(text, idf, threshold=licenses.THRESHOLD):
    """The best window of a text by dense loops over all starts and lengths."""
    words = licenses._tokens(text)
    best = {}
    for name, templates in licenses.TEMPLATES.items():
        for template in templates:
            bag = licenses.terms(template)
            most = max(idf(w) for w in bag)
            norm = sum((n * idf(w)) ** 2 for w, n in bag.items())
            for s in range(len(words)):
                if words[s] not in bag or licenses.NEGATIONS & set(words[max(0, s - 3) : s]):
                    continue
                for e in range(s + 1, min(len(words), s + 2 * bag.total()) + 1):
                    window = Counter(words[s:e])
                    if any(w in licenses.NEGATIONS and w not in bag for w in window):
                        break
                    length = sum((n * (idf(w) if w in bag else min(idf(w), most))) ** 2 for w, n in window.items())
                    # Shared words count as often as the window has them, the template's weight each time.
                    dot = sum(n * bag[w] * idf(w) ** 2 for w, n in window.items())
                    cosine = dot / math.sqrt(length * norm)
                    if cosine >= threshold - 1e-12:
                        best[name] = max(best.get(name, 0), cosine)
    if not best:
        return None, None
    chosen = min(best, key=lambda k: (-round(best[k], 12), k))
    if chosen == "BSD-2-Clause" and "BSD-3-Clause" in best:
        chosen = "BSD-3-Clause"
    return chosen, best[chosen]


def test_scan_equals_plain_loops(spark):
    rng = random.Random(9)
    rows = [(f"{i}/{p}", t) for i, (p, (_, t)) in enumerate(FILES.items()) if t]
    for i in range(40):
        header = rng.choice(licenses.TEMPLATES[rng.choice(sorted(licenses.TEMPLATES))]).split()
        for _ in range(rng.randint(0, 4)):
            header.insert(rng.randint(0, len(header)), rng.choice("acme the of license v2 Foo".split()))
        rows.append((f"f{i}/a", " ".join(f"w{rng.randint(0, 60)}" for _ in range(20)) + " " + " ".join(header)))
    seen = Counter(w for _, t in rows for w in set(licenses._tokens(t)))
    idf = lambda w: math.log((1 + len(rows)) / (1 + seen[w])) + 1
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string"), is_licence_file=F.lit(False)).collect()
    texts = dict(rows)
    for r in got:
        name, cosine = plain_best(texts[r["path"]], idf)
        assert r["license"] == name and (cosine is None or abs(r["cosine"] - cosine) < 1e-9)
