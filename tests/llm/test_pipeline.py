"""The registered training-data queries and the pipeline on the small tables."""

import duckdb
import pytest

import corpus_pipeline
from tablelens.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.statements()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "pages", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    want = con.execute(sql.statements()[name])
    columns = [d[0] for d in want.description]
    got = queries.registered()[name](spark, sf).select(*columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_stages_keep_what_they_should(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.select("doc_id").distinct().count())
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4] == kept[5] > kept[0] / 2


def test_stages_on_no_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
