"""The operators' queries against their SQL, and the pipeline against its stages, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import queries


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, data, db, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = db.sql(queries.SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in found.fetchall())


def test_pipeline_keeps_what_its_rules_keep(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data)
    assert out.columns == [*docs.columns, "shard", "place"]
    got = {r.doc_id: r for r in out.collect()}
    passed = {r.doc_id for r in queries.op6_quality_rules(spark, data).filter("kept").collect()}
    dirty = {r.doc_id for r in queries.op3_decontaminate(spark, data).filter("contaminated").collect()}
    classes = corpus_pipeline.minhash.near_duplicate_classes(docs.filter(F.col("doc_id").isin(*passed)))
    kept = {r.doc_id for r in classes.filter("kept").collect()}
    assert set(got) == kept - dirty and out.count() == len(got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[i] for i, r in got.items())
