"""Search for every label: the documents that give the queries are chosen on ids alone."""

from __future__ import annotations

from linkloom.checks import search
from tests.test_queries import SF_DIR


def test_only_texts_of_first_documents_are_moved(spark, monkeypatch):
    staged, stage = {}, search.stage
    monkeypatch.setattr(search, "stage", lambda df, name: staged.setdefault(name, (df, stage(df, name)))[1])
    search.search_many_hybrid(spark, SF_DIR)
    plan = staged["firsts"][0]._jdf.queryExecution().executedPlan().toString()
    assert "doc_id:bigint" in plan and "text:string" not in plan
    embedded = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    known = embedded.join(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id")
    want = {(str(r.label), r.doc_id) for r in known.groupBy("label").agg({"doc_id": "min"}).toDF("label", "doc_id").collect()}
    assert {(r.query_id, r.doc_id) for r in staged["firsts"][1].collect()} == want
    assert staged["queries"][1].count() == len(want)
