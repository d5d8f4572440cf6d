"""Registered queries on a stored catalog with its index, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..functions.text import stable_id
from ..operators import blockmax, quantised
from ..operators.listing import hidden_ids
from ..operators.numbering import numbered
from ..plans import index as index_plan
from ..plans import search as search_plan
from ..plans.sync import edit, publish, remove
from ..session import stage
from ..sources import feeds
from ..sources.tables import TableStore
from .ingest import new_store
from .scalar import sql_snippet
from .search import (
    HYBRID_QUERY,
    QUERY,
    _fused_sql,
    _LABEL_VECTORS,
    _RANKED,
    _shown,
    _text_ctes,
    _UPDATED_SQL,
    _vector_batch_ctes,
    _vector_ctes,
    _VISIBLE_VECTOR,
    label_vectors,
    query_vector,
)
from .views import BATCH_TIME, BOOKMARKS_SQL, VECTORS_SQL, bookmarks, doc_url, table, vectors

BLOCK_ROWS = 64


def _coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vectors and their stored codes."""
    rows = vectors(spark, sf_dir)
    return rows, stage(quantised.codes(rows), "codes")


def vector_topk_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(quantised.nearest(*_coded(spark, sf_dir), query_vector(spark, sf_dir)))


def vector_topk_quantised_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label queries over visible vectors."""
    hidden = hidden_ids(bookmarks(spark, sf_dir))
    return _shown(quantised.topk_quantised(*_coded(spark, sf_dir), label_vectors(spark, sf_dir), hidden_ids=hidden))


def indexed_store(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> TableStore:
    """The catalog with its vectors and an index of small blocks."""
    store = new_store(spark)
    with_hash = vectors(spark, sf_dir).withColumn("embedded_text_hash", F.lit(None).cast("string"))
    store.commit("rows", {"bookmarks": bookmarks(spark, sf_dir) if rows is None else rows, "vectors": with_hash})
    index_plan.build_index(store, "index", BLOCK_ROWS)
    return store


def search_bm25_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = indexed_store(spark, sf_dir)
    index, stats = index_plan.open_blocks(store)
    return _shown(blockmax.search_blockmax(index, stats, hidden_ids(store.read("bookmarks")), QUERY)[0])


def hybrid_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship search on a stored catalog: block index, stored vectors, point reads of the results."""
    store = indexed_store(spark, sf_dir)
    found = search_plan.search(
        store.read("bookmarks"), HYBRID_QUERY, store.read("vectors"), query_vector(spark, sf_dir), index=index_plan.open_blocks(store)
    )
    return _shown(found.select("rank", "score", "id", "source", "url", "title", "summary"))


def edited_store(spark: SparkSession, sf_dir: str) -> TableStore:
    """An indexed catalog after its last fifth came by a feed, labelled rows lost their summary and toxic ones went."""
    rows = bookmarks(spark, sf_dir)
    late = F.col("created_at") >= F.lit("2024-01-01 10:00:00").cast("timestamp")
    store = indexed_store(spark, sf_dir, rows.filter(~late))
    placed = rows.filter(late).withColumns({"source_order": F.lit(0), "page_no": F.lit(0), "pos": F.xxhash64("url")})
    marks = spark.createDataFrame([], "feed string, mark timestamp")
    publish(store, list(feeds.FEEDS.values()), placed, marks, BATCH_TIME, "late")
    labels = table(spark, sf_dir, "labels").select(stable_id(doc_url()).alias("id"), "toxic")
    edit(store, labels.select("id", F.lit("").alias("summary")), BATCH_TIME, "edit")
    remove(store, labels.filter("toxic = 1").select("id"), "remove")
    return store


def index_stats_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus statistics summed from the parts that inserts, edits and deletions replaced."""
    stats = index_plan.corpus_stats(edited_store(spark, sf_dir).read("corpus_parts"))
    return stats.select(F.col("n").cast("bigint").alias("n"), F.round("mean_length", 6).alias("mean_length"))


def search_blockmax_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block search over old blocks, stale ids and recent postings."""
    store = edited_store(spark, sf_dir)
    index, stats = index_plan.open_blocks(store)
    return _shown(blockmax.search_blockmax(index, stats, hidden_ids(store.read("bookmarks")), QUERY)[0])


def result_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visible bookmark as a numbered block of text, newest first."""
    rows = bookmarks(spark, sf_dir).filter(~F.col("hidden")).select("id", "source", "url", "title", "summary", "created_at")
    counted = numbered(rows, [F.col("created_at").desc(), F.col("id")], start=1)
    return counted.select("n", F.md5(render.text_block(F.col("n"))).alias("line"))


_LINE_SQL = f"""n || '. ' || CASE source WHEN 'x' THEN '[X]' WHEN 'raindrop' THEN '[R]' WHEN 'github' THEN '[G]' ELSE '[M]' END
  || ' ' || title || chr(10) || '   ' || url
  || CASE WHEN summary <> '' THEN chr(10) || '   ' || {sql_snippet('summary', 100, 97)} ELSE '' END"""

QUERIES = {
    "search_bm25_blockmax": search_bm25_blockmax,
    "hybrid_search_indexed": hybrid_search_indexed,
    "index_stats_after_edits": index_stats_after_edits,
    "search_blockmax_after_edits": search_blockmax_after_edits,
    "result_lines_all": result_lines_all,
    "vector_topk_quantised": vector_topk_quantised,
    "vector_topk_quantised_batch": vector_topk_quantised_batch,
}

ORACLE = {
    "search_bm25_blockmax": f"WITH {BOOKMARKS_SQL}, {_text_ctes(QUERY)} {_RANKED} text_hits",
    "hybrid_search_indexed": f"""WITH {BOOKMARKS_SQL}, {VECTORS_SQL}, {_text_ctes(HYBRID_QUERY)},
{_vector_ctes(_VISIBLE_VECTOR)}, {_fused_sql(['text_hits', 'vector_hits'], 20)}
SELECT rank, round(score, 6) AS score, id, source, url, title, summary FROM fused JOIN bookmarks USING (id)""",
    "index_stats_after_edits": f"""WITH {_UPDATED_SQL},
lengths AS (SELECT a.id, count(t.term) AS length FROM after a LEFT JOIN token_rows t USING (id) GROUP BY a.id)
SELECT count(*) AS n, round(avg(length), 6) AS mean_length FROM lengths""",
    "search_blockmax_after_edits": f"WITH {_UPDATED_SQL}, {_text_ctes(QUERY).replace('FROM bookmarks', 'FROM after')} {_RANKED} text_hits",
    "vector_topk_quantised": f"WITH {VECTORS_SQL}, {_vector_ctes()} {_RANKED} vector_hits",
    "vector_topk_quantised_batch": f"""WITH {BOOKMARKS_SQL}, {VECTORS_SQL}, {_LABEL_VECTORS}, {_vector_batch_ctes(_VISIBLE_VECTOR)}
SELECT query_id, id, round(score, 6) AS score, rank FROM vector_batch""",
    "result_lines_all": f"""WITH {BOOKMARKS_SQL},
shown AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM bookmarks WHERE NOT hidden)
SELECT n, md5({_LINE_SQL}) AS line FROM shown""",
}
