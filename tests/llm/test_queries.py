"""Registered corpus queries against their oracles, and the pipeline's stages."""

import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

from tidewatch.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in found.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        from tidewatch.llm.common import materialize

        docs = materialize(stage(spark, docs, DATA), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert docs.count() > 0
    assert docs.filter("not round_trip").count() == 0
    # each stage on its own input, by brute force: see the operators' tests


def test_near_copies_leave_one_document(spark):
    import corpus_pipeline
    from conftest_llm import frame
    from test_ngram_join import brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, docs, DATA).select("doc_id").collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert kept == {c for _, c in want.values()}
    assert frame(spark, []).count() == 0
