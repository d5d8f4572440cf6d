"""Exact cosine search over embeddings.

Arithmetic runs in float64 inside Arrow batches. The final score of a row is always the same
left-to-right sum over its elements, whatever batch it travels in, so equal vectors get equal
scores and ties fall to the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import top_ranked, top_ranked_by_query

CANDIDATES = 50

# Largest query matrix (float64 bytes) shipped to every task.
QUERY_MATRIX_BYTES = 64 << 20

# Rows per block when both sides are cut into a grid.
BLOCK_QUERIES = 2048
BLOCK_VECTORS = 20_000

# A float64 product of unit vectors is this close to the left-to-right sum for any practical width.
ROUNDING = 1e-9


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two float arrays as a column; 0 for unequal lengths, a zero vector, or null or non-finite elements."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    norm_a, norm_b = dot(a, a), dot(b, b)
    usable = (F.size(a) == F.size(b)) & (norm_a != 0) & (norm_b != 0)
    score = F.when(usable, dot(a, b) / (F.sqrt(norm_a) * F.sqrt(norm_b))).otherwise(F.lit(0.0))
    return F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))


def _matrix(embeddings: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of width ``dim`` and their values, one row each."""
    lengths = pc.fill_null(pc.list_value_length(embeddings), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    values = embeddings.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return rows, values.astype(np.float64).reshape(len(rows), dim)


def _sequential_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products of two equal-shaped matrices, summed from the first column to the last."""
    total = np.zeros(a.shape[0])
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        total += x * y
    return total


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scale = np.sqrt(_sequential_dot(a, a)) * np.sqrt(_sequential_dot(b, b))
    dots = _sequential_dot(a, b)
    with np.errstate(invalid="ignore"):
        scores = np.divide(dots, scale, out=np.zeros_like(dots), where=scale != 0)
    return np.where(np.isfinite(scores), scores, 0.0)


def score_all(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """``(id, score)`` of every non-blank vector against one query vector."""
    q = np.asarray(query, dtype=np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if q.size:
                rows, matrix = _matrix(batch.column("embedding"), q.size)
                scores[rows] = _cosine(matrix, np.broadcast_to(q, matrix.shape))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])

    present = vectors.select("id", "embedding").filter(F.size("embedding") > 0)
    return present.mapInArrow(score, "id string, score double")


def vector_topk(
    vectors: DataFrame, query: Sequence[float], k: int = CANDIDATES, hidden_ids: DataFrame | None = None
) -> DataFrame:
    """``(id, score, rank)`` of the ``k`` nearest vectors.

    Rows of ``hidden_ids`` are left out when given. They are removed from the narrow score rows,
    so the embeddings themselves are never shuffled.
    """
    scored = score_all(vectors, query)
    if hidden_ids is not None:
        scored = scored.join(hidden_ids.select("id"), "id", "left_anti")
    return top_ranked(scored, k)


# --- many query vectors -----------------------------------------------------------------------

_PAIR = "query_id string, id string, score double"


def _units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without a finite length above 0 become zeros, as they score 0."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    good = np.isfinite(norms) & (norms != 0)
    return np.divide(np.where(good, matrix, 0.0), np.where(good, norms, 1.0))


def _best_pairs(ids: np.ndarray, matrix: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int):
    """For each query, the exact ``k`` best rows of one block as ``(row, score)``.

    ``matrix`` holds the vectors with the query's width, at row numbers ``rows`` of ``ids``; all
    other rows score 0. A block product finds every row that could be among the ``k`` best within
    the rounding bound, and only those are summed exactly.
    """
    units, targets = _units(matrix), _units(queries)
    for start in range(0, len(targets), 256):
        block = targets[start : start + 256] @ units.T
        rough = np.zeros((block.shape[0], len(ids)))
        rough[:, rows] = block
        for i, line in enumerate(rough):
            if len(line) > k:
                floor = np.partition(line, len(line) - k)[len(line) - k] - ROUNDING
                near = np.flatnonzero(line >= floor)
            else:
                near = np.arange(len(line))
            exact = np.zeros(len(near))
            at = np.searchsorted(rows, near)
            known = (at < len(rows)) & (rows[np.minimum(at, max(len(rows) - 1, 0))] == near) if len(rows) else np.zeros(len(near), bool)
            picked = matrix[at[known]]
            exact[known] = _cosine(picked, np.broadcast_to(queries[start + i], picked.shape))
            order = np.lexsort((ids[near], -exact))[:k]
            yield start + i, near[order], exact[order]


def _block_result(ids: pa.Array, embeddings: pa.ListArray, query_ids: np.ndarray, groups, k: int) -> pa.RecordBatch:
    """Best pairs of one block of vectors against query matrices grouped by width."""
    names = ids.to_numpy(zero_copy_only=False).astype(str)
    out_q, out_id, out_score = [], [], []
    for dim, (members, queries) in groups.items():
        rows, matrix = _matrix(embeddings, dim)
        for i, picked, scores in _best_pairs(names, matrix, rows, queries, k):
            out_q.append(np.repeat(query_ids[members[i]], len(picked)))
            out_id.append(names[picked])
            out_score.append(scores)
    columns = [np.concatenate(c) if c else np.array([], dtype=t) for c, t in ((out_q, str), (out_id, str), (out_score, float))]
    arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, ["query_id", "id", "score"])


def _by_width(vectors: Iterable[Sequence[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    widths: dict[int, list[int]] = {}
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    for i, v in enumerate(rows):
        widths.setdefault(len(v), []).append(i)
    return {w: (np.array(m), np.stack([rows[i] for i in m])) for w, m in widths.items()}


def vector_topk_batch(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATES,
    hidden_ids: DataFrame | None = None,
    matrix_bytes: int = QUERY_MATRIX_BYTES,
) -> DataFrame:
    """``(query_id, id, score, rank)`` of the ``k`` nearest vectors of each ``(query_id, embedding)``.

    The query matrix is measured first. Up to ``matrix_bytes`` it travels to the tasks and the
    vectors are read in place; beyond that both sides are cut into blocks of bounded size and
    every pair of blocks is multiplied in a task of its own. Either way a task only lets the
    ``k`` best of a query out, never all pairs.
    """
    rows = vectors.select(F.col("id").cast("string"), "embedding").filter(F.size("embedding") > 0)
    if hidden_ids is not None:
        rows = rows.join(hidden_ids.select("id"), "id", "left_anti")
    asked = queries.select(F.col("query_id").cast("string"), "embedding").filter(F.size("embedding") > 0)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("cells")).first()
    if size.cells * 8 <= matrix_bytes:
        best = _topk_broadcast(rows, asked, k)
    else:
        best = _topk_grid(rows, asked, size.n, k)
    return top_ranked_by_query(best, k)


def _topk_broadcast(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    table = asked.toArrow()
    query_ids = np.array(table.column("query_id").to_pylist(), dtype=str)
    groups = _by_width(table.column("embedding").to_pylist())
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, groups))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grouped = shared.value
        best = pa.Table.from_batches([], _PAIR_ARROW)
        for batch in batches:
            if batch.num_rows and len(ids):
                found = _block_result(batch.column("id"), batch.column("embedding"), ids, grouped, k)
                best = _best_of(pa.concat_tables([best, pa.Table.from_batches([found])]), k)
        yield from best.to_batches()

    return rows.mapInArrow(score, _PAIR)


def _best_of(pairs: pa.Table, k: int) -> pa.Table:
    """The ``k`` best pairs of each query: what a task carries from batch to batch."""
    order = [("query_id", "ascending"), ("score", "descending"), ("id", "ascending")]
    pairs = pairs.take(pc.sort_indices(pairs, order)).combine_chunks()
    ids = pairs.column("query_id").to_numpy(zero_copy_only=False).astype(str)
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.array([], int)
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
    return pairs.filter(pa.array(place < k))


def _topk_grid(rows: DataFrame, asked: DataFrame, n_queries: int, k: int) -> DataFrame:
    n_rows = rows.count()
    q_blocks = max(1, math.ceil(n_queries / BLOCK_QUERIES))
    v_blocks = max(1, math.ceil(n_rows / BLOCK_VECTORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(v_blocks)).cast("int")).withColumn("qb", every(q_blocks))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("vb", every(v_blocks))

    def score(vector_block: pa.Table, query_block: pa.Table) -> pa.Table:
        if not vector_block.num_rows or not query_block.num_rows:
            return pa.Table.from_batches([], _PAIR_ARROW)
        block = vector_block.combine_chunks()
        ids = np.array(query_block.column("query_id").to_pylist(), dtype=str)
        groups = _by_width(query_block.column("embedding").to_pylist())
        embeddings = pa.concat_arrays(block.column("embedding").chunks)
        names = pa.concat_arrays(block.column("id").chunks)
        return pa.Table.from_batches([_block_result(names, embeddings, ids, groups, k)])

    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(score, _PAIR)


_PAIR_ARROW = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])
