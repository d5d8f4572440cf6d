"""Search against straightforward Python implementations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions.text import query_tokens
from linkloom.operators import fulltext, vectors
from linkloom.operators.fusion import reciprocal_rank_fusion, top_ranked
from linkloom.operators.listing import hidden_ids
from linkloom.plans import index as index_plan
from linkloom.plans import search as plan
from linkloom.schema import INDEXED_FIELDS
from tests.helpers import by, table

WORDS = ["spark", "sparkle", "spar", "node.js", "Café", "cafe", "straße", "x", "data", "databricks", "ÉTÉ", "été-bar"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [
        {
            "url": f"https://e.org/{i}",
            "title": " ".join(rng.choices(WORDS, k=3)),
            "summary": " ".join(rng.choices(WORDS, k=rng.randint(0, 12))),
            "keywords": ",".join(rng.choices(WORDS, k=2)),
            "notes": rng.choice(["", "note data"]),
            "hidden": rng.random() < 0.15,
        }
        for i in range(120)
    ]


@pytest.fixture(scope="module")
def stored(spark, rows):
    return table(spark, *rows).cache()


def bm25(rows, query, fields=INDEXED_FIELDS, weights=None):
    weights, terms = weights or {}, query_tokens(query)
    if not terms:
        return {}
    docs = [{f: query_tokens(r[f]) for f in INDEXED_FIELDS} for r in rows]
    length = [sum(map(len, d.values())) for d in docs]
    mean = sum(length) / len(docs)
    scores = [0.0] * len(docs)
    matched = [True] * len(docs)
    for term in terms:
        hits = [{f: sum(t.startswith(term) for t in d[f]) for f in fields} for d in docs]
        df = sum(any(h.values()) for h in hits)
        raw = math.log((len(docs) - df + 0.5) / (df + 0.5))
        idf = raw if raw > 0 else 1e-6
        for i, h in enumerate(hits):
            freq = sum(weights.get(f, 1.0) * n for f, n in h.items())
            matched[i] = matched[i] and any(h.values())
            if freq:
                scores[i] += idf * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * length[i] / mean))
    return {r["url"]: s for r, s, m in zip(rows, scores, matched) if m and not r["hidden"]}


def check(stored, found, want):
    """Every match with its score, ranked by score and then id."""
    urls = {i: r["url"] for i, r in by(stored, "id").items()}
    got = found.orderBy("rank").collect()
    assert {urls[r.id]: r.score for r in got} == pytest.approx(want, rel=1e-9)
    assert [r.rank for r in got] == list(range(1, len(got) + 1))
    assert [r.id for r in got] == [r.id for r in sorted(got, key=lambda r: (-r.score, r.id))]


@pytest.mark.parametrize("query", ["spar", "data cafe", "Node.js", "ete bar", "x x", "straße", "zzz", "spark databricks caf"])
def test_scan_index_and_batch_agree(spark, stored, rows, query):
    want = bm25(rows, query)
    check(stored, fulltext.search_scan(stored, query, 200), want)
    index = index_plan.index_rows(stored)
    stats = fulltext.corpus_stats(fulltext.doc_lengths(stored))
    ids = hidden_ids(stored)
    check(stored, fulltext.search_index(index, stats, ids, query, 200), want)
    queries = spark.createDataFrame([("q", query), ("blank", " . ")], "query_id string, query string")
    batch = fulltext.search_batch(index, stats, ids, queries, 200)
    assert {r.query_id for r in batch.collect()} <= {"q"}
    check(stored, batch, want)


def test_fields_and_weights(spark, stored, rows):
    weights = {"title": 3.0, "summary": 0.5}
    want = bm25(rows, "spark data", ["title", "summary"], weights)
    got = fulltext.search_scan(stored, "spark data", 200, fields=["title", "summary"], weights=weights)
    check(stored, got, want)
    index, stats = index_plan.index_rows(stored), fulltext.corpus_stats(fulltext.doc_lengths(stored))
    got = fulltext.search_index(index, stats, hidden_ids(stored), "spark data", 200, fields=["title", "summary"], weights=weights)
    check(stored, got, want)
    with pytest.raises(ValueError):
        fulltext.search_scan(stored, "x", fields=["raw_content"])


def test_query_without_tokens_finds_nothing(spark, stored):
    assert fulltext.search_scan(stored, "  ... ").count() == 0
    assert plan.search(stored, " ").count() == 0
    assert plan.search(stored, "", limit=7).count() == 7


def test_no_row_travels_for_a_scan(stored):
    text = fulltext.search_scan(stored, "spark data")._jdf.queryExecution().explainString(
        stored.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


# --- vectors ----------------------------------------------------------------------------------


def cosine(a, b):
    if len(a) != len(b):
        return 0.0
    dot = na = nb = 0.0
    for x, y in zip(a, b):
        dot += x * y
        na += x * x
        nb += y * y
    return dot / (math.sqrt(na) * math.sqrt(nb)) if na and nb else 0.0


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(f"v{i:03d}", rng.normal(size=8).astype("float32").tolist()) for i in range(90)]
    same = rows[3][1]
    rows += [(f"copy{i:03d}", same) for i in range(60)]
    rows += [("blank", []), ("null", None), ("zero", [0.0] * 8), ("short", [1.0, 2.0]), ("short2", [2.0, 1.0])]
    return rows


@pytest.fixture(scope="module")
def vector_table(spark, vector_rows):
    return spark.createDataFrame(vector_rows, "id string, embedding array<float>").repartition(3).cache()


def nearest(rows, q, k, skip=()):
    scored = [(i, cosine(v, q)) for i, v in rows if v and i not in skip]
    return [(i, n + 1) for n, (i, _) in enumerate(sorted(scored, key=lambda p: (-p[1], p[0]))[:k])]


def test_vector_topk(spark, vector_table, vector_rows):
    for q in (vector_rows[3][1], vector_rows[10][1], [0.0] * 8, [1.0, 1.0], [1.0, 0.0, 0.0]):
        got = [(r.id, r.rank) for r in vectors.vector_topk(vector_table, q, 20).orderBy("rank").collect()]
        assert got == nearest(vector_rows, q, 20)


def test_hidden_vectors_are_left_out(spark, vector_table, vector_rows):
    hidden = spark.createDataFrame([("copy000",), ("v003",)], "id string")
    got = vectors.vector_topk(vector_table, vector_rows[3][1], 5, hidden).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == nearest(vector_rows, vector_rows[3][1], 5, {"copy000", "v003"})


@pytest.mark.parametrize("matrix_bytes", [1 << 20, 0])
def test_vector_batch_is_exact_both_ways(spark, vector_table, vector_rows, monkeypatch, matrix_bytes):
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 40)
    asked = [(f"q{i}", v) for i, (_, v) in enumerate(vector_rows) if i % 9 == 3 and v] + [("two", [1.0, 1.0]), ("none", [])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    found = vectors.vector_topk_batch(vector_table, queries, 12, matrix_bytes=matrix_bytes).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.id, r.rank))
    assert got == {q: nearest(vector_rows, v, 12) for q, v in asked if v}


def test_cosine_column(spark, vector_table, vector_rows):
    q = vector_rows[0][1]
    column = vectors.cosine_similarity(F.col("embedding"), F.array(*[F.lit(x).cast("float") for x in q]))
    got = {r.id: r.s for r in vector_table.select("id", column.alias("s")).collect()}
    for i, v in vector_rows:
        if v:
            assert got[i] == pytest.approx(cosine(v, q), abs=1e-12)


# --- fusion -----------------------------------------------------------------------------------


def test_fusion(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2)], "id string, rank int")
    b = spark.createDataFrame([("q", 1), ("r", 2)], "id string, rank int")
    got = top_ranked(reciprocal_rank_fusion([a, b]), 2).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == [("q", 1), ("p", 2)]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)
    bound = sum(1 / 61 for _ in range(2))
    assert all(r.score <= bound for r in reciprocal_rank_fusion([a, b]).collect())


def test_hydrate_drops_missing_ids_after_the_limit(spark, stored):
    some = by(stored)["https://e.org/0"]
    hits = spark.createDataFrame([("gone", 1.0, 1), (some["id"], 0.5, 2)], "id string, score double, rank int")
    got = plan.hydrate(hits, stored, 2).collect()
    assert [(r.url, r.rank) for r in got] == [("https://e.org/0", 2)]


def test_hybrid_search_uses_both_legs(spark, stored, rows):
    ids = [r["id"] for r in by(stored).values()]
    vecs = spark.createDataFrame([(i, [float(n), 1.0]) for n, i in enumerate(ids)], "id string, embedding array<float>")
    text = fulltext.search_scan(stored, "spark")
    near = vectors.vector_topk(vecs, [1.0, 0.0], 50, hidden_ids(stored))
    want = [r.id for r in top_ranked(reciprocal_rank_fusion([text, near]), 10).orderBy("rank").collect()]
    assert [r.id for r in plan.search(stored, "spark", vecs, [1.0, 0.0], limit=10).collect()] == want
    index, stats = index_plan.index_rows(stored), fulltext.corpus_stats(fulltext.doc_lengths(stored))
    indexed = plan.search(stored, "spark", vecs, [1.0, 0.0], limit=10, index=(index, stats))
    assert [r.id for r in indexed.collect()] == want


def test_damaged_vectors_score_zero_on_every_path(spark):
    from linkloom.operators import vectors as v

    nan = float("nan")
    rows = [("a", [1.0, 0.0]), ("b", [nan, 1.0]), ("c", [None, 1.0]), ("d", [float("inf"), 0.0]), ("e", [-1.0, 0.0])]
    table_ = spark.createDataFrame(rows, "id string, embedding array<float>")
    want = [("a", 1.0), ("b", 0.0), ("c", 0.0)]
    one = v.vector_topk(table_, [1.0, 0.0], 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in one] == want
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    for limit in (1 << 20, 0):
        many = v.vector_topk_batch(table_, asked, 3, matrix_bytes=limit).orderBy("rank").collect()
        assert [(r.id, r.score) for r in many] == want
    scored = table_.select("id", v.cosine_similarity(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("s"))
    assert {r.id: r.s for r in scored.collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -1.0}


def test_vector_codec_keeps_bits_and_nulls(spark):
    from linkloom.sources.vector_codec import decode_vector, encode_vector

    vectors = [[1.0, -2.5, 3e38], None, [], [0.1], [float("nan"), 1.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<float>").repartition(2)
    back = {r.i: r for r in rows.select("i", "v", encode_vector("v").alias("b")).select("*", decode_vector("b").alias("w")).collect()}
    for i, v in enumerate(vectors):
        want = None if v is None else np.asarray(v, "<f4").tobytes()
        assert (None if back[i].b is None else bytes(back[i].b)) == want
        assert back[i].w is None if v is None else np.asarray(back[i].w, "<f4").tobytes() == want
    broken = spark.createDataFrame([(bytearray(b"1234567"),), (None,), (bytearray(b"abcd"),), (bytearray(),)], "b binary").coalesce(1)
    assert [None if r.v is None else len(r.v) for r in broken.select(decode_vector("b").alias("v")).collect()] == [None, None, 1, 0]
