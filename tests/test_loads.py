"""Bucketed targets, record positions and pooled sums."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperlode.functions.resources import last_wins
from paperlode.operators import aggregates, embedding
from paperlode.sources import records, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_load_reads_only_its_folders(spark, tmp_path):
    table = str(tmp_path / "t")
    first = spark.createDataFrame([(f"k{i}", "old", i) for i in range(400)], "id STRING, v STRING, n INT")
    sinks.append_new(first, table, "id", digits=2)
    load = sinks.bucketed(spark.createDataFrame([("k3",), ("new",)], "id STRING"), "id", 2)
    stored = spark.read.parquet(table)
    assert sinks.stored_digits(stored) == 2
    known = sinks.in_buckets_of(stored, load)
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan(known))
    assert 0 < len(known.inputFiles()) and known.select(sinks.BUCKET).distinct().count() <= 2
    again = [("k3", "changed", 1), ("new", "b", 2), ("new", "a", 9), (None, "x", 1), (None, "x", 1)]
    for _ in range(2):
        sinks.append_new(spark.createDataFrame(again, first.schema), table, "id", digits=2)
    rows = {r["id"]: r["v"] for r in sinks.read_bucketed(spark, table).collect()}
    assert rows["k3"] == "old" and rows["new"] == "a" and None in rows and len(rows) == 402


def test_kept_duplicate_does_not_depend_on_the_partitions(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 20, rng.randint(0, 50), rng.choice("abc")) for i in range(600)]
    want = {}
    for k, n, v in rows:
        want[k] = min(want.get(k, (99, "z")), (n, v))
    for parts in (1, 7):
        for digits in (0, 1):
            table = str(tmp_path / f"t{parts}{digits}")
            df = spark.createDataFrame(rows, "k INT, n INT, v STRING").repartition(parts)
            sinks.append_new(df, table, "k", "n", digits)
            got = sinks.read_bucketed(spark, table).collect()
            assert {r["k"]: (r["n"], r["v"]) for r in got} == want and len(got) == 20


def test_vectors_of_a_bucketed_table(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.createDataFrame([(1, "deep graph"), (2, ""), (2, "x y"), (3, None)], "id LONG, text STRING")
    embedding.index_update(df.filter("id < 3"), path, "id", "text", digits=1)
    embedding.index_update(df, path, "id", "text", digits=1)
    rows = sinks.read_bucketed(spark, path).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 3] and rows[0].asDict().keys() == {"id", "embedding"}


@pytest.mark.parametrize("size", ["64", "1000", "1m"])
def test_records_of_many_splits(spark, tmp_path, size):
    for name, n in (("a.txt", 80), ("b.txt", 1), ("c.txt", 37), ("empty.txt", 0)):
        body = "".join(f"NodeName={name[0]}{i} X=1\n  Note=n{i} X={i}\n" for i in range(n))
        (tmp_path / name).write_text(("head NodeNam=x k=v\n" if name != "b.txt" else "") + body)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = records.read_kv_records(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {r["fields"]["NodeName"]: r["fields"] for r in rows}
    want = [f"{c}{i}" for c, n in (("a", 80), ("b", 1), ("c", 37)) for i in range(n)]
    assert sorted(got) == sorted(want) and len(rows) == len(want)
    assert all(r["X"] == k[1:] for k, r in got.items())
    assert len({(r["file"], r["split"], r["place"]) for r in rows}) == len(rows)


def test_last_of_equal_keys_counts(spark):
    pairs = [("b", "1"), ("a", "2"), ("b", "3"), ("c", None), ("a", "4"), ("c", "5"), ("b", None)]
    df = spark.createDataFrame([(pairs,), ([],), (None,)], "p ARRAY<STRUCT<key: STRING, value: STRING>>")
    got = [r["m"] for r in df.select(last_wins(F.col("p")).alias("m")).collect()]
    assert got == [{"a": "4", "b": None, "c": "5"}, {}, None]


def test_mean_pool_sends_whole_vectors_once(spark):
    rows = [(i % 3, [float(i), 1.0, -float(i)], int(i % 2)) for i in range(30)] + [(9, [5.0, 5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "doc INT, embedding ARRAY<FLOAT>, mask INT").repartition(4)
    pooled = aggregates.mean_pool(df, "doc")
    assert len(re.findall(r"Exchange hashpartitioning", plan(pooled))) == 1
    got = {r["doc"]: r["embedding"] for r in pooled.collect()}
    for d in range(3):
        kept = [i for i in range(30) if i % 3 == d and i % 2]
        assert got[d] == pytest.approx([sum(kept) / 5, 1.0, -sum(kept) / 5])
    assert got[9] == [0.0, 0.0, 0.0]
