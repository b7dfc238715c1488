"""Every stage of the pipeline on what the stage before it kept, against plain versions."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from paperlode.llm import queries
from paperlode.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before the first and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append((name, docs))
    return {name: df for name, df in found}


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"], str(r)))


def test_quality_keeps_what_the_rules_keep(spark, sf_dir, stages):
    kept = queries.QUERIES["op2_host_rules"](spark, sf_dir).filter("kept").select("doc_id")
    want = stages["documents"].join(kept, "doc_id", "left_semi")
    assert rows(stages["quality_rules"]) == rows(want) and 0 < want.count() < stages["documents"].count()


def test_near_duplicates_leave_one_of_each_class(stages):
    before, after = rows(stages["quality_rules"]), rows(stages["simhash_near_dedup"])
    sets = {}
    for r in before:
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i for i in ids if find(i) == i}
    kept = {r["doc_id"] for r in after}
    assert want <= kept and len(kept - want) <= 0.02 * len(ids)
    assert all(r in before for r in after)


def test_repeats_go_byte_by_byte(stages):
    before, after = rows(stages["simhash_near_dedup"]), rows(stages["suffix_dedup"])
    bodies = {r["doc_id"]: r["text"].encode() for r in before}
    seen = Counter(b[i : i + 200] for b in bodies.values() for i in range(len(b) - 199))
    assert len(after) == len(before)
    for r in after:
        body, gone = bodies[r["doc_id"]], set()
        for i in range(len(body) - 199):
            if seen[body[i : i + 200]] > 1:
                gone |= set(range(i, i + 200))
        rest = bytes(x for i, x in enumerate(body) if i not in gone).decode("utf-8", "ignore")
        assert r["text"] == rest and r["n_chars"] == len(rest)


def test_mix_meets_the_targets(stages):
    before, after = rows(stages["suffix_dedup"]), rows(stages["source_mix"])
    size = Counter()
    for r in before:
        size[r["source"]] += len(WORD.findall(r["text"]))
    taken = Counter()
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    total = sum(size.values())
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        free = (1.5 * total - sum(2 * size[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and weight[s] * free > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert taken[s] == (2 * size[s] if s in full else int(weight[s] * free))
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2
    whole = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == whole[r["doc_id"]] or WORD.findall(r["text"]) == WORD.findall(whole[r["doc_id"]])[: len(WORD.findall(r["text"]))] for r in after)


def test_ids_are_those_of_the_tokenizer_and_decode_back(stages):
    ranks = load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows(stages["source_mix"]):
        ids = plain.encode_ordinary(r["text"])
        want[r["doc_id"], tuple(ids), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    got = Counter()
    for r in stages["byte_bpe"].collect():
        ids = [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]
        assert r["n_tokens"] == len(ids)
        got[r["doc_id"], tuple(ids), r["decoded_sha256"]] += 1
    assert got == want


def test_run_equals_the_stages(spark, sf_dir, stages):
    out = corpus_pipeline.run(spark, sf_dir)
    both = [df.select(*sorted(df.columns)) for df in (out, stages["byte_bpe"])]
    assert both[0].exceptAll(both[1]).count() == both[1].exceptAll(both[0]).count() == 0
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "decoded_sha256"}
    assert out.filter(F.col("ids").isNull()).count() == 0
