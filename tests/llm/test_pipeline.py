import os

import pytest
from cases import documents

import corpus_pipeline as P


def test_stages_on_odd_documents(spark):
    docs = documents(spark)
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids)) and not {0, 1, 2, 5, 6, 13} & set(ids)
    assert P.STAGES[-1][1](spark, docs, "").count() > 0


def test_stages_on_nothing(spark):
    docs = documents(spark).limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not here")
def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 < r["length"] <= 1024 for r in rows)
