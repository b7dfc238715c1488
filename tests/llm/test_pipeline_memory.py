"""Python workers of the pipeline: few at once, and holding little."""

import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from paperlode.llm import bpe, common, suffixes

PYTHON = re.compile(r"\b(MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython)\b")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_needs_two_workers(spark, monkeypatch):
    rows = [(i, "en", "a", f"word{i} " * 60 + "same passage of words " * 12, 5) for i in range(12)]
    docs = spark.createDataFrame([*rows, (12, "en", "b", "", 0), (13, None, None, None, 0)], "doc_id long, lang string, source string, text string, n_chars long")
    found = []

    def noted(df, label, settle=corpus_pipeline.settle if hasattr(corpus_pipeline, "settle") else None):
        found.append(plan_of(df))
        return settle(df, label)

    monkeypatch.setattr(corpus_pipeline, "settle", noted, raising=False)
    for stage in (corpus_pipeline.suffix_stage, corpus_pipeline.encode_stage):
        out = stage(spark, docs, "")
        found.append(plan_of(out))
        assert out.count() == 14
    assert all(len(PYTHON.findall(p)) <= 1 for p in found)


def test_removed_texts_stay_apart_from_null(spark):
    passage = "\u00e9x" * 100
    texts = [passage, passage, None, "", "own words", "a" + passage]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.suffix_stage(spark, docs, "").collect()}
    assert got == {0: ("", 0), 1: ("", 0), 2: (None, None), 3: ("", 0), 4: ("own words", 9), 5: ("a", 1)}
    assert suffixes.remove_repeats(docs).count() == 6


def test_a_worker_remembers_as_many_words_as_it_is_told():
    own = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY), 50)
    whole = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))
    text = " ".join(f"zq{i}xv" for i in range(500))
    assert own.encode(text) == whole.encode(text) and len(own) + len(own.old) <= 100


def test_numbers_need_no_python_workers(spark):
    rows, count = common.numbered(spark.range(20).withColumn("x", F.col("id") % 7), [F.col("x"), F.col("id")])
    assert count == 20 and "Python" not in plan_of(rows) and "ExistingRDD" not in plan_of(rows)
    assert [r["number"] for r in rows.orderBy("x", "id").collect()] == list(range(20))
