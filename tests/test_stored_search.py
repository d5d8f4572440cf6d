"""Block-maximum search, quantised vectors, corpus parts and numbering against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.checks.ingest import new_store
from linkloom.operators import blockmax, fulltext, quantised, vectors
from linkloom.operators.listing import hidden_ids
from linkloom.operators.numbering import numbered
from linkloom.plans import index as index_plan
from linkloom.plans.sync import edit, remove
from tests.helpers import T0, by, table
from tests.test_search import bm25

WORDS = ["spark", "sparkle", "spar", "cafe", "Café", "data", "databricks", "x", "étude", "internationalization", "internationalisation"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [
        {"url": f"https://e.org/{i}", "title": rng.choice(WORDS), "keywords": "", "notes": "", "summary": " ".join(rng.choices(WORDS, k=rng.choice([0, 2, 5, 40]))), "hidden": rng.random() < 0.1}
        for i in range(300)
    ]


@pytest.fixture(scope="module")
def stored(spark, rows):
    store = new_store(spark)
    store.commit("rows", {"bookmarks": table(spark, *rows)})
    index_plan.build_index(store, "index", 8)
    return store


def ranking(store, query, limit):
    index, stats = index_plan.open_blocks(store)
    found, report = blockmax.search_blockmax(index, stats, hidden_ids(store.read("bookmarks")), query, limit)
    urls = {i: r["url"] for i, r in by(store.read("bookmarks"), "id").items()}
    return [(urls[r.id], r.id, r.score, r.rank) for r in found.orderBy("rank").collect()], report


@pytest.mark.parametrize("query", ["spar", "data cafe", "x", "sparkle étude", "internationaliz", "internationalisation x", "zzz", "", "spark databricks caf x"])
def test_blocks_rank_like_the_scan(stored, rows, query):
    want = bm25(rows, query)
    for limit in (3, 50):
        found, report = ranking(stored, query, limit)
        scores = {url: score for url, _, score, _ in found}
        assert scores == pytest.approx({u: want[u] for u in scores}, rel=1e-9)
        best = sorted(want.values(), reverse=True)[:limit]
        assert [s for _, _, s, _ in found] == pytest.approx(best, rel=1e-9)
        assert [(u, r) for u, i, s, r in found] == [(u, n) for n, (u, i, s, _) in enumerate(sorted(found, key=lambda f: (-f[2], f[1])), 1)]


def test_fewer_rows_are_read_for_fewer_results(stored):
    few, many = ranking(stored, "spar", 3)[1], ranking(stored, "spar", 300)[1]
    index, _ = index_plan.open_blocks(stored)
    every = index.postings.filter(F.col("term").startswith("spar")).count()
    assert many.rows == every and few.rows < every / 2
    assert sum(b for b, _ in few.rounds) < few.candidates


def test_edits_and_deletions_are_seen(spark, rows):
    store = new_store(spark)
    store.commit("rows", {"bookmarks": table(spark, *rows)})
    index_plan.build_index(store, "index", 8)
    ids = {r["url"]: i for i, r in by(store.read("bookmarks"), "id").items()}
    changed = {r["url"]: "spark spark new" for r in rows[:20]}
    edit(store, spark.createDataFrame([(ids[u], s) for u, s in changed.items()], "id string, summary string"), T0, "edit")
    remove(store, spark.createDataFrame([(ids[r["url"]],) for r in rows[20:40]], "id string"), "remove")
    now = [{**r, "summary": changed.get(r["url"], r["summary"])} for r in rows[:20] + rows[40:]]
    for query in ("spark", "new spar"):
        want = bm25(now, query)
        assert {u: s for u, _, s, _ in ranking(store, query, 300)[0]} == pytest.approx(want, rel=1e-9)
    assert not index_plan.fold_in(store, "fold-0", share=0.5) and store.read("postings_recent").count() > 0
    before = ranking(store, "spark", 300)[0]
    assert index_plan.fold_in(store, "fold-1") and store.read("stale_ids").isEmpty() and store.read("postings_recent").isEmpty()
    assert [(u, i) for u, i, *_ in ranking(store, "spark", 300)[0]] == [(u, i) for u, i, *_ in before]
    stats = index_plan.corpus_stats(store.read("corpus_parts")).first()
    plain = fulltext.corpus_stats(fulltext.doc_lengths(store.read("bookmarks"))).first()
    assert (stats.n, stats.mean_length) == (plain.n, pytest.approx(plain.mean_length))
    assert "doc_lengths" not in index_plan.open_index(store)[1]._jdf.queryExecution().toString()


def test_statistics_of_nothing(spark):
    store = new_store(spark)
    index_plan.build_index(store, "index")
    index, stats = index_plan.open_blocks(store)
    assert stats.first().n == 0
    assert blockmax.search_blockmax(index, stats, spark.createDataFrame([], "id string"), "spark")[0].isEmpty()


def vector_rows(n, seed):
    draw = np.random.default_rng(seed)
    found = [[float(x) for x in v] for v in draw.normal(size=(n, 16)) * draw.choice([1e-3, 1.0, 1e4], size=(n, 1))]
    odd = [[0.0] * 16, [float("nan")] * 16, [1.0, 2.0], [], None, found[0], found[0], [float("inf")] + [0.0] * 15]
    return [(f"v{i}", v) for i, v in enumerate(found + odd)]


@pytest.mark.parametrize("k", [1, 7, 500])
def test_quantised_equals_exact(spark, k):
    rows = spark.createDataFrame(vector_rows(400, 1), "id string, embedding array<float>").repartition(4)
    coded = quantised.codes(rows).cache()
    hidden = spark.createDataFrame([("v3",), ("v9",)], "id string")
    queries = spark.createDataFrame(
        [("a", vector_rows(3, 2)[0][1]), ("b", rows.filter("id = 'v0'").first().embedding), ("c", [1.0, 1.0]), ("d", [0.0] * 16), ("e", [])],
        "query_id string, embedding array<float>",
    )
    shown = lambda found: sorted(tuple(r) for r in found.select("query_id", "id", "score", "rank").collect())
    assert shown(quantised.topk_quantised(rows, coded, queries, k, hidden)) == shown(vectors.vector_topk_batch(rows, queries, k, hidden))
    one = queries.first().embedding
    plain = lambda found: [tuple(r) for r in found.orderBy("rank").collect()]
    assert plain(quantised.nearest(rows, coded, one, k)) == plain(vectors.vector_topk(rows, one, k))
    narrow = quantised.topk_quantised(rows, coded, queries, k, hidden, matrix_bytes=8)
    assert shown(narrow) == shown(vectors.vector_topk_batch(rows, queries, k, hidden))


def test_few_vectors_are_read_in_full(spark):
    rows = spark.createDataFrame(vector_rows(2000, 3), "id string, embedding array<float>")
    asked = spark.createDataFrame([("a", vector_rows(1, 4)[0][1])], "query_id string, embedding array<float>")
    near = quantised.candidates(quantised.codes(rows), asked, 10)
    assert 10 <= near.count() < 100
    wide = spark.range(50).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(768)), lambda i: F.sin(i * F.col("id")).cast("float")).alias("embedding"))
    assert quantised.codes(wide).agg(F.sum(F.length("codes"))).first()[0] <= 50 * 768


def test_numbered(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(7)).alias("key"), "id").repartition(9)
    found = [(r.key, r.id, r.n) for r in numbered(rows, [F.col("key").desc(), F.col("id")]).collect()]
    assert sorted(found, key=lambda r: r[2]) == [(k, i, n) for n, (k, i) in enumerate(sorted(((k, i) for k, i, _ in found), key=lambda r: (-r[0], r[1])))]
    assert numbered(rows.limit(0), [F.col("id")]).isEmpty()
