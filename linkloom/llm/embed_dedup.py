"""Near-equal vectors: tiles of PCA-ordered vectors compared on their leading dimensions first."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..session import stage
from .common import components, map_batches, spread_order
from .vectors import doubles, matrix, row_products, usable

THRESHOLD = 0.93
#: Vectors the rotation is fitted on (a fixed choice by id). It changes the speed only, never the result.
SAMPLE_ROWS = 4_000
#: Vectors in a tile; two tiles are held at a time.
TILE_ROWS = 2_048
#: Leading dimensions that place a vector in a cell, and the dimensions added in each step of a comparison.
CELL_DIMENSIONS, STEP = 2, 8
#: Slack for rounding in the bounds; what they let through is compared exactly.
SLACK = 1e-9


def rotation(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """For the vector lengths in the sample an orthogonal matrix whose first columns carry the most variance.

    Vectors of a length that is too rare for the sample are compared as they are, without a turn."""
    order = spread_order("id")
    sample = vectors.select("vector", "id").orderBy(order, "id").limit(rows).select("vector").toArrow()["vector"].to_pylist()
    found = {}
    for length in {len(v) for v in sample}:
        units = np.array([v for v in sample if len(v) == length], float)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        found[length] = np.linalg.eigh(units.T @ units)[1][:, ::-1].copy()
    return found


def pairs_above(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rotated unit vectors whose cosine can reach ``threshold``.

    The product over the leading dimensions is exact; what the others can add is at most the product of
    the two norms of the rest. A pair is dropped as soon as both together fall short.
    """
    a, b = _suffix_norms(left), _suffix_norms(right)
    size = left.shape[1]
    first = min(STEP, size)
    partial = left[:, :first] @ right[:, :first].T
    rows, columns = np.nonzero(partial + np.outer(a[:, first], b[:, first]) >= threshold - SLACK)
    sums = partial[rows, columns]
    for at in range(first, size, STEP):
        upto = min(at + STEP, size)
        sums = sums + row_products(left[rows, at:upto], right[columns, at:upto])
        alive = sums + a[rows, upto] * b[columns, upto] >= threshold - SLACK
        rows, columns, sums = rows[alive], columns[alive], sums[alive]
    return rows, columns


def _suffix_norms(vectors: np.ndarray) -> np.ndarray:
    """Norm of each vector's dimensions from each position on; the last column is 0."""
    squares = np.cumsum(vectors[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.hstack([squares, np.zeros((len(vectors), 1))]))


def cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of matching rows of original vectors in double precision."""
    return row_products(left, right) / (np.sqrt(row_products(left, left)) * np.sqrt(row_products(right, right)))


def compare(left: pa.Table, right: pa.Table, turn: np.ndarray | None, threshold: float) -> pa.Table:
    """What one pair of tiles adds: rows ``id, n`` with the number of others (copies counted) that a vector
    links with, and rows ``id, other`` that connect all vectors connected within the two tiles.

    A tile meets itself as one table: the other side holds the same rows, but in an order of its own."""
    own = left["tile"][0] == right["tile"][0]
    right = left if own else right
    a, b = matrix(left["vector"]), matrix(right["vector"])
    rows, columns = pairs_above(_turned(a, turn), _turned(b, turn), threshold)
    if own:
        one_way = rows < columns
        rows, columns = rows[one_way], columns[one_way]
    linked = cosine(a[rows], b[columns]) >= threshold
    rows, columns = rows[linked], columns[linked]
    ids = [t["id"].to_numpy() for t in (left, right)]
    copies = [t["copies"].to_numpy() for t in (left, right)]
    gained = [np.zeros(len(i), np.int64) for i in ids]
    np.add.at(gained[0], rows, copies[1][columns])
    np.add.at(gained[1], columns, copies[0][rows])
    counted = [i[g > 0] for i, g in zip(ids, gained)]
    links = _spanning(ids[0][rows].tolist(), ids[1][columns].tolist())
    n = np.concatenate([g[g > 0] for g in gained]).tolist() + [0] * len(links)
    found = np.concatenate(counted).tolist()
    return pa.table(
        {
            "id": pa.array(found + [x for x, _ in links], pa.int64()),
            "other": pa.array([None] * len(found) + [y for _, y in links], pa.int64()),
            "n": pa.array(n, pa.int64()),
        }
    )


def _turned(vectors: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return units if turn is None else units @ turn


def _spanning(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """The pairs that join two parts not yet joined by earlier ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    kept = []
    for a, b in zip(left, right):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _in_tiles(distinct: DataFrame, turns: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """``id, copies, vector, label, tile`` and the cell; a tile is a bounded part of a cell."""
    width = math.sqrt(2 - 2 * threshold) + SLACK

    def transform():
        def step(batch: pa.RecordBatch) -> list:
            cells = []
            for vector in batch.column("vector").to_pylist():
                unit = np.array(vector) / np.linalg.norm(vector)
                turn = turns.get(len(vector))
                leading = unit[:CELL_DIMENSIONS] if turn is None else unit @ turn[:, :CELL_DIMENSIONS]
                at = np.floor(leading / width).astype(int).tolist()
                cells.append((len(vector), *at, *[0] * (CELL_DIMENSIONS - len(at))))
            return [*batch.columns, *map(list, zip(*cells))]

        return step

    kept = distinct.select("id", "copies", "label", "vector")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    placed = map_batches(kept, transform, f"{fields}, length int, x int, y int")
    return stage(placed, "cells")


def _tile_pairs(cells: DataFrame) -> DataFrame:
    """``pair`` with the tiles on its two sides: all pairs of tiles of one cell or of cells that touch."""
    sizes = cells.groupBy("label", "length", "x", "y").agg(F.ceil(F.count("*") / F.lit(TILE_ROWS)).cast("int").alias("tiles"))
    # every neighbour once: the cell itself and half of those around it
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = sizes.withColumn("step", F.explode(steps)).select(
        "label", "length", (F.col("x") + F.col("step.dx")).alias("x"), (F.col("y") + F.col("step.dy")).alias("y"),
        F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("tiles").alias("tiles0"),
    )
    met = near.join(sizes, ["label", "length", "x", "y"])
    met = met.withColumn("t0", F.explode(F.sequence(F.lit(0), F.col("tiles0") - 1)))
    inside = (F.col("x") == F.col("x0")) & (F.col("y") == F.col("y0"))
    met = met.withColumn("t", F.explode(F.sequence(F.when(inside, F.col("t0")).otherwise(0), F.col("tiles") - 1)))
    sides = met.select(tile_name("x0", "y0", "t0").alias("left"), tile_name("x", "y", "t").alias("right"))
    return sides.withColumn("pair", F.concat_ws("|", "left", "right"))


def tile_name(x: str, y: str, t: str):
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ("label", "length", x, y, t)])


def _compared(cells: DataFrame, turns: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """``id, n`` and ``id, other`` rows of all pairs of tiles."""
    pairs = stage(_tile_pairs(cells), "tile-pairs")
    sizes = cells.groupBy("label", "length", "x", "y").agg(F.ceil(F.count("*") / F.lit(TILE_ROWS)).cast("int").alias("tiles"))
    tiled = cells.join(sizes, ["label", "length", "x", "y"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiled = tiled.select("id", "copies", "vector", "length", tile_name("x", "y", "t").alias("tile"))
    def side(name: str) -> GroupedData:
        # new names: the two sides come from one table
        met = tiled.join(pairs.select(F.col(name).alias("tile"), "pair"), "tile")
        return met.toDF(*met.columns).groupBy("pair")


    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return compare_schema().empty_table()
        return compare(left, right, turns.get(left["length"][0].as_py()), threshold)

    return side("left").cogroup(side("right")).applyInArrow(both, "id long, other long, n long")


def compare_schema() -> pa.Schema:
    return pa.schema([("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def near_equal(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: ``key, n_links, component_id, kept``.

    Vectors are compared when their labels are equal and not null and they are equally long. Null, zero or
    empty vectors and those with a null or non-finite component link with nothing. Copies are one vector
    with a number of copies, so a group of copies is never compared within itself; its rows all count as
    linked. Keys are expected to be unique and whole numbers; rows that repeat a key link like others but
    share its component. Other columns are ignored; an empty table gives no rows.

    Vectors with equal label are dealt into cells by their leading principal components. Two unit vectors
    with cosine c differ by at most sqrt(2 - 2c) in every component, so only cells that touch are
    compared; a cell is cut into tiles of bounded size and every pair of tiles is one small task.
    """
    checked = F.col(label).isNotNull() & usable(vector)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), doubles(vector).alias("vector"), checked.alias("good"))
    good = rows.where("good")
    distinct = stage(good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    turns = rotation(distinct, SAMPLE_ROWS)
    found = stage(_compared(_in_tiles(distinct, turns, threshold), turns, threshold), "links")
    roots = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    degrees = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    reps = distinct.join(degrees, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    n_links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    # 128 bits of hash stand for a vector on the way back to its copies.
    name = [F.xxhash64("vector").alias("h"), F.xxhash64(F.lit("g"), "vector").alias("g")]
    reps = reps.select("label", *name, n_links.alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = good.select("id", "label", *name).join(reps, ["label", "h", "g"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long"), F.col("id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", kept.alias("kept"))
