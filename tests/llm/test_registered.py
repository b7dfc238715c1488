import duckdb
import pytest

import corpus_pipeline
from paperlode.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf_dir, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        base.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    want = base.sql(ORACLES[name]).df()
    assert sorted(want.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if got[c].dtype == float:
            assert (abs(got[c] - want[c]) < 1e-6).all()
        else:
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() and set(out.columns) >= set(docs.columns) - {"text"} | {"ids", "n_tokens"}
