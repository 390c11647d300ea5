"""The corpus pipeline and the registered queries of the training-data operators."""

import pytest
from oracle import same

import corpus_pipeline
from quern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, tables, name):
    same(queries.queries()[name](spark, tables), queries.oracle_sql()[name], tables)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] == counts[3]
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {
        r["doc_id"] for r in spark.read.parquet(str(tmp_path / "personal_data")).select("doc_id").collect()
    }


def test_empty(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0
