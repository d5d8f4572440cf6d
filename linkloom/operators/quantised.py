"""Exact nearest vectors from a first pass over one byte per entry.

Each vector is stored a second time as the whole numbers its unit vector rounds to, one byte each, with the
length of what the rounding left over. That length bounds how far the cosine with any query can be from the
product of the codes. One pass over the codes finds all vectors whose upper bound reaches the ``k``-th best
lower bound; only those are read in full and scored as ``vectors.vector_topk`` scores them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .fusion import top_ranked_by_query
from .vectors import CANDIDATES, QUERY_MATRIX_BYTES, ROUNDING, _by_width, _cosine, _matrix, _units, vector_topk_batch

LEVELS = 127
#: Candidates looked up by literal id; more are joined.
POINT_READS = 1000
#: Rows of one product with all queries: bounds what a task holds to this many scores.
SCORES = 1 << 22

CODES = "id string, width int, scale double, error double, codes binary"
_CODES = pa.schema([("id", pa.string()), ("width", pa.int32()), ("scale", pa.float64()), ("error", pa.float64()), ("codes", pa.binary())])
_BOUNDS = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("lower", pa.float64()), ("upper", pa.float64())])


def codes(vectors: DataFrame) -> DataFrame:
    """``(id, width, scale, error, codes)`` of every vector that is not blank.

    A vector that scores 0 with every query (zero, or with entries that are null or not finite) has a scale of
    0 and no codes.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            embeddings = batch.column("embedding")
            widths = pc.list_value_length(embeddings).to_numpy(zero_copy_only=False)
            scale, error = np.zeros(len(widths)), np.zeros(len(widths))
            made: list[bytes] = [b""] * len(widths)
            for width in np.unique(widths):
                rows, matrix = _matrix(embeddings, int(width))
                units = _units(matrix)
                steps = np.abs(units).max(axis=1) / LEVELS
                whole = np.rint(np.divide(units, steps[:, None], out=np.zeros_like(units), where=steps[:, None] > 0))
                scale[rows] = steps
                error[rows] = np.sqrt(np.square(units - whole * steps[:, None]).sum(axis=1))
                for row, step, line in zip(rows, steps, whole.astype(np.int8)):
                    made[row] = line.tobytes() if step else b""
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(widths, pa.int32()), pa.array(scale), pa.array(error), pa.array(made, pa.binary())], schema=_CODES
            )

    rows = vectors.select(F.col("id").cast("string"), "embedding").filter(F.size("embedding") > 0)
    return rows.mapInArrow(encode, CODES)


def _batch_bounds(batch: pa.RecordBatch, groups: dict, n_queries: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosine of each row with each query."""
    widths = batch.column("width").to_numpy(zero_copy_only=False)
    scale = batch.column("scale").to_numpy(zero_copy_only=False)
    error = batch.column("error").to_numpy(zero_copy_only=False)
    lower, upper = np.zeros((batch.num_rows, n_queries)), np.zeros((batch.num_rows, n_queries))
    for width, (members, units) in groups.items():
        rows = np.flatnonzero((widths == width) & (scale > 0))
        if not len(rows):
            continue
        flat = b"".join(batch.column("codes").take(pa.array(rows)).to_pylist())
        product = np.frombuffer(flat, np.int8).reshape(len(rows), width).astype(np.float64) @ units.T * scale[rows, None]
        spread = error[rows, None] + ROUNDING
        usable = units.any(axis=1)  # a query that is zero scores 0 with everything
        lower[np.ix_(rows, members)] = np.where(usable, product - spread, 0.0)
        upper[np.ix_(rows, members)] = np.where(usable, product + spread, 0.0)
    return lower, upper


def candidates(coded: DataFrame, queries: DataFrame, k: int, hidden_ids: DataFrame | None = None) -> DataFrame:
    """``(query_id, id)`` of all pairs that can be among the ``k`` best of a query.

    The queries travel to the tasks. A task carries, per query, the ``k``-th best lower bound it has met from
    batch to batch and lets out only rows that reach it; the same cut over all tasks follows.
    """
    rows = coded if hidden_ids is None else coded.join(hidden_ids.select("id"), "id", "left_anti")
    table = queries.toArrow()
    names = np.array(table.column("query_id").to_pylist(), dtype=object)
    groups = {w: (members, _units(matrix)) for w, (members, matrix) in _by_width(table.column("embedding").to_pylist()).items()}
    shared = coded.sparkSession.sparkContext.broadcast((names, groups))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grouped = shared.value
        best = np.full((k, len(ids)), -np.inf)
        step = max(1, SCORES // max(1, len(ids)))
        for whole in batches:
            for at in range(0, whole.num_rows if len(ids) else 0, step):
                batch = whole.slice(at, step)
                lower, upper = _batch_bounds(batch, grouped, len(ids))
                met = np.vstack([best, lower])
                best = np.partition(met, len(met) - k, axis=0)[len(met) - k :]
                row, query = np.nonzero(upper >= best.min(axis=0))
                columns = [pa.array(ids[query], pa.string()), batch.column("id").take(pa.array(row)), pa.array(lower[row, query]), pa.array(upper[row, query])]
                yield pa.RecordBatch.from_arrays(columns, schema=_BOUNDS)

    pairs = stage(rows.select("id", "width", "scale", "error", "codes").mapInArrow(bound, "query_id string, id string, lower double, upper double"), "bounds")
    kept = top_ranked_by_query(pairs.select("query_id", "id", F.col("lower").alias("score")), k)
    floors = kept.groupBy("query_id").agg(F.min("score").alias("floor"))
    return pairs.join(floors, "query_id").filter(F.col("upper") >= F.col("floor")).select("query_id", "id")


def _scored(pairs: DataFrame) -> DataFrame:
    """Exact ``(query_id, id, score)`` of rows of ``(query_id, id, embedding, target)``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            widths = [pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in ("embedding", "target")]
            same = np.where(widths[0] == widths[1], widths[0], 0)
            for width in np.unique(same[same > 0]):
                rows = pa.array(np.flatnonzero(same == width))
                left, right = (_matrix(batch.column(c).take(rows), int(width))[1] for c in ("embedding", "target"))
                scores[rows.to_numpy()] = _cosine(left, right)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(scores)], ["query_id", "id", "score"])

    return pairs.select("query_id", "id", "embedding", "target").mapInArrow(score, "query_id string, id string, score double")


def topk_quantised(
    vectors: DataFrame,
    coded: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATES,
    hidden_ids: DataFrame | None = None,
    matrix_bytes: int = QUERY_MATRIX_BYTES,
) -> DataFrame:
    """``(query_id, id, score, rank)`` of ``vectors.vector_topk_batch`` for rows of ``(query_id, embedding)``.

    ``coded`` is ``codes(vectors)``. The query matrix is measured first; one too large to travel is
    answered without codes.
    """
    asked = queries.select(F.col("query_id").cast("string"), "embedding").filter(F.size("embedding") > 0)
    size = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("cells")).first()
    if size.cells * 8 > matrix_bytes:
        return vector_topk_batch(vectors, queries, k, hidden_ids, matrix_bytes)
    near = stage(candidates(coded, asked, k, hidden_ids), "near")
    ids = [r.id for r in near.select("id").distinct().limit(POINT_READS + 1).collect()]
    full = vectors.select(F.col("id").cast("string"), "embedding")
    full = full.filter(F.col("id").isin(ids)) if len(ids) <= POINT_READS else full.join(near.select("id").distinct(), "id", "left_semi")
    pairs = near.join(full, "id").join(F.broadcast(asked.withColumnRenamed("embedding", "target")), "query_id")
    return top_ranked_by_query(_scored(pairs), k)


def nearest(vectors: DataFrame, coded: DataFrame, query: Sequence[float], k: int = CANDIDATES, hidden_ids: DataFrame | None = None) -> DataFrame:
    """``(id, score, rank)`` of ``vectors.vector_topk`` for one query vector."""
    asked = vectors.sparkSession.createDataFrame([("q", [float(x) for x in query])], "query_id string, embedding array<double>")
    return topk_quantised(vectors, coded, asked, k, hidden_ids).select("id", "score", "rank")
