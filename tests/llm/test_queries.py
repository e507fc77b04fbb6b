"""The queries against their SQL, and the pipeline, on the smallest data."""

import pytest

import corpus_pipeline
from check import differences, oracle_connection
from corpusgap.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert differences(got, duck.execute(queries.ORACLES[name]).df()) == []


@pytest.mark.parametrize("name", ["op5_toxicity", "op8_language_id"])
def test_each_document_once(spark, name):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES[name](spark, SF)
    assert got.count() == documents.count() and got.select("doc_id").exceptAll(documents.select("doc_id")).count() == 0


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard join", "decontamination", "mixing", "token shards"]
    out = corpus_pipeline.run(spark, SF)
    rows = out.select("slot", "doc_id").collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
