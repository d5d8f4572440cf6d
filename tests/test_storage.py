"""How stages, stored tables and landed pages are laid out as they grow."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkloom.checks import ingest
from linkloom.session import scratch_path, stage
from linkloom.sources.tables import TableStore, default_tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def as_dealt(spark):
    """Shuffle partitions stay as they are, as those of a large table do."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_a_bucket_is_written_by_several_tasks(spark, as_dealt):
    store = TableStore(spark, scratch_path(spark, "store"), default_tables(1))
    rows = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("id"), F.lit(3).alias("length"))
    store.commit("rows", {"doc_lengths": rows})
    assert len(list(Path(store.root).glob("doc_lengths/v=1/bucket=0/*.parquet"))) > 1
    assert sorted(store.read("doc_lengths").collect()) == sorted(rows.collect())


def test_stages_and_tables_are_packed(spark):
    staged = stage(spark.range(10), "packed")
    assert all(".zstd." in f for f in staged.inputFiles())
    store = TableStore(spark, scratch_path(spark, "store"), default_tables(1))
    store.commit("rows", {"stale_ids": spark.range(10).select(F.col("id").cast("string").alias("id"))})
    assert all(".zstd." in f for f in store.read("stale_ids").inputFiles())


def test_more_documents_land_in_more_files(spark, monkeypatch):
    few = ingest.landed_fetches(spark, DATA)
    monkeypatch.setattr(ingest, "DOCS_PER_FILE", 50)
    many = ingest.landed_fetches(spark, DATA)
    files = [len(list(Path(p.path).glob("*.json.gz"))) for p in (few, many)]
    assert files[1] > 2 * files[0] and many.files_per_batch > few.files_per_batch == 2
    assert few.read().exceptAll(many.read()).isEmpty() and many.read().exceptAll(few.read()).isEmpty()


def test_slices_lie_in_few_buckets(spark):
    """A slice of a table rewrites the buckets next to each other that it lies in, not all of them."""
    store = TableStore(spark, scratch_path(spark, "sliced"), default_tables(8))
    urls = spark.range(4000).select(F.concat(F.lit("https://e.org/"), F.col("id")).alias("url"))
    placed = urls.select(store.slice_of("bookmarks", 3).alias("slice"), store.bucket_of("bookmarks").alias("bucket"))
    found = placed.groupBy("slice").agg(F.count("*").alias("n"), F.count_distinct("bucket").alias("buckets")).collect()
    assert sorted(r.slice for r in found) == [0, 1, 2]
    assert max(r.buckets for r in found) <= 4 and min(r.n for r in found) > 1000


def test_the_pages_of_all_feeds_have_one_shuffle_of_texts(spark):
    """Documents are grouped once; the pages of the other feeds are cut from the same groups."""
    adaptive = "spark.sql.adaptive.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        plan = ingest.all_pages(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(adaptive, before)
    assert plan.count("ReusedExchange") >= 2
