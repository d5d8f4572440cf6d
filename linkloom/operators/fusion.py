"""Ranked lists: cutting, numbering and reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_CONSTANT = 60


def top_ranked(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best ``(id, score)`` rows with a rank from 1; ties go to the smaller id.

    The cut is a bounded top-k per task plus a merge; only the ``k`` survivors are numbered.
    """
    best = scored.select("id", "score").orderBy(F.col("score").desc(), F.col("id")).limit(k)
    order = Window.orderBy(F.col("score").desc(), F.col("id"))
    return best.withColumn("rank", F.row_number().over(order))


def top_ranked_by_query(scored: DataFrame, k: int) -> DataFrame:
    """``top_ranked`` for each ``query_id``. Tasks cut their own rows to ``k`` before shuffling."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    ranked = scored.select("query_id", "id", "score").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], by: list[str] | None = None, k: int = RRF_CONSTANT) -> DataFrame:
    """Sum of ``1 / (k + rank)`` per id over any number of ranked lists."""
    keys = [*(by or []), "id"]
    union = reduce(DataFrame.unionByName, [ranked.select(*keys, "rank") for ranked in lists])
    return union.groupBy(*keys).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))
