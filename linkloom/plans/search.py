"""Search jobs: full text, vectors, and both fused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blockmax, fulltext, vectors
from ..operators.fusion import reciprocal_rank_fusion, top_ranked, top_ranked_by_query
from ..operators.listing import hidden_ids, list_recent

RESULT_LIMIT = 20
CANDIDATES = 50

# Up to this many results are looked up by literal id.
POINT_READS = 1000


def hydrate(ranked: DataFrame, bookmarks: DataFrame, limit: int) -> DataFrame:
    """Full rows of a ranking already cut to ``limit``; ids without a row drop out.

    The score and rank columns stay, the latter giving the order. A short ranking is computed
    first, so that its ids reach the scan as a filter and only row groups that may hold one of
    them are read. A longer one is a plain join.
    """
    hits = ranked.select("id", "score", "rank")
    if limit <= POINT_READS:
        found = hits.collect()
        hits = F.broadcast(bookmarks.sparkSession.createDataFrame(found, hits.schema))
        bookmarks = bookmarks.filter(F.col("id").isin([row.id for row in found]))
    return bookmarks.join(hits, "id").orderBy("rank")


def fused_ranking(
    bookmarks: DataFrame,
    query: str,
    vector_table: DataFrame | None = None,
    query_vector: Sequence[float] | None = None,
    limit: int = RESULT_LIMIT,
    candidates: int = CANDIDATES,
    include_hidden: bool = False,
    index: tuple[DataFrame | blockmax.BlockIndex, DataFrame] | None = None,
) -> DataFrame:
    """``(id, score, rank)`` of a text leg and, when a query vector is given, a vector leg.

    ``index`` is ``(postings or block index, corpus_stats)``; without it the text leg scans the bookmarks.
    """
    if index is None:
        legs = [fulltext.search_scan(bookmarks, query, candidates)]
    elif isinstance(index[0], blockmax.BlockIndex):
        legs = [blockmax.search_blockmax(*index, hidden_ids(bookmarks), query, candidates)[0]]
    else:
        legs = [fulltext.search_index(*index, hidden_ids(bookmarks), query, candidates)]
    if vector_table is not None and query_vector is not None:
        unwanted = None if include_hidden else hidden_ids(bookmarks)
        legs.append(vectors.vector_topk(vector_table, query_vector, candidates, unwanted))
    return top_ranked(reciprocal_rank_fusion(legs), limit)


def search(
    bookmarks: DataFrame,
    query: str,
    vector_table: DataFrame | None = None,
    query_vector: Sequence[float] | None = None,
    limit: int = RESULT_LIMIT,
    **options,
) -> DataFrame:
    """The best bookmarks for a query, full rows in rank order; an empty query lists the newest."""
    if query == "":
        return list_recent(bookmarks, limit)
    return hydrate(fused_ranking(bookmarks, query, vector_table, query_vector, limit, **options), bookmarks, limit)


def search_many(
    bookmarks: DataFrame,
    index: DataFrame,
    stats: DataFrame,
    queries: DataFrame,
    vector_table: DataFrame | None = None,
    limit: int = RESULT_LIMIT,
    candidates: int = CANDIDATES,
    include_hidden: bool = False,
) -> DataFrame:
    """``(query_id, id, score, rank)`` for rows of ``(query_id, query[, embedding])``."""
    legs = [fulltext.search_batch(index, stats, hidden_ids(bookmarks), queries, candidates)]
    if vector_table is not None:
        unwanted = None if include_hidden else hidden_ids(bookmarks)
        legs.append(vectors.vector_topk_batch(vector_table, queries, candidates, unwanted))
    return top_ranked_by_query(reciprocal_rank_fusion(legs, ["query_id"]), limit)
