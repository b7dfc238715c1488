"""The string kernel against a plain one, and words of tokens against words of texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlode.llm import queries, toxicity


def plain_weights(word):
    """All subsequences of three characters within the span, by three nested loops."""
    s, out = f"\x01{word}\x02", {}
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, len(s)):
                if k - i < toxicity.SPAN:
                    key = s[i] + s[j] + s[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def plain_kernel(a, b):
    x, y = plain_weights(a), plain_weights(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm


WORDS = ["idiot", "id1ot", "i", "banana", "aaaaaaa", "stupid", "stuuupid", "été", "日本語", "x-y", "idiotic", "qq"]


def test_kernel_equals_plain_loops():
    landmarks = ["idiot", "stupid", "banana", "aaaa", "été"]
    got = toxicity.Kernel(landmarks)(WORDS)
    want = np.array([[plain_kernel(w, m) for m in landmarks] for w in WORDS])
    assert np.abs(got - want).max() < 1e-6


def texts():
    rng = random.Random(1)
    pieces = [1, 1, 1, 2, 3, 9, 80]
    made = [
        " ".join("".join(rng.choice("abéA.1-!(") for _ in range(rng.choice(pieces))) for _ in range(rng.randint(0, 30)))
        for _ in range(1500)
    ]
    return made + [None, "", "  ", "s t u p i d", "a b", "a b c d, e f", "x " * 50, "q" * 5000, "a- b. c", "a b c- d"]


def test_tokens_give_the_words_of_the_text():
    reader = toxicity.Reader(toxicity.Kernel(["word"]))
    for text in texts():
        counts, others = reader.bag(text)
        got = Counter(others)
        for token, n in counts.items():
            for w in toxicity.words_of(token):
                got[w] += n
        assert got == Counter(toxicity.word_list(text))


@pytest.mark.parametrize("remembered", [200_000, 0])
def test_features_equal_plain_sums(monkeypatch, remembered):
    """Also where there is hardly room, so that words are forgotten again and again."""
    monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
    monkeypatch.setattr(toxicity, "CHUNK", 20_000 if remembered else 25)
    landmarks = ["idiot", "stupid", "banana"]
    asked = [" ".join(random.Random(i).choices(WORDS + ["the,", "(x)"], k=20)) for i in range(70)] + texts()[-10:]
    got = toxicity.Reader(toxicity.Kernel(landmarks)).features(asked)
    for text, row in zip(asked, got):
        k = np.array([[plain_kernel(w, m) for m in landmarks] for w in toxicity.word_list(text)] or [[0.0] * 3])
        close = np.maximum(k - toxicity.CLOSE, 0).sum(axis=0) / (1 - toxicity.CLOSE)
        assert np.abs(row - np.concatenate([k.max(axis=0), np.log1p(close)])).max() < 1e-5


def test_query_scores_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.QUERIES["op1_string_kernel"](spark, sf_dir).collect()
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("h")).collect()}
    assert {r["doc_id"]: r["held_out"] for r in rows} == held
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
