"""Whitening of vectors by the leading components of their covariance.

Vectors are whole numbers (``fixed_point`` makes them from real ones), so every sum over them is exact: their
number, the sums of each dimension, and, after the nearest whole number to the mean is taken off, the sums of
products. Tasks add up their rows, Spark adds up the tasks, and the driver sees one square matrix as wide as a vector is long,
whose leading eigenpairs come from ``feast``. Vectors of different lengths are whitened apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import BATCH_BYTES
from .feast import largest

COMPONENTS = 32
#: Whole numbers up to this are exact as doubles, and so is a sum of products that stays below.
EXACT = 1 << 53
#: Differences from the mean up to this are multiplied as doubles, larger ones as Python's whole numbers.
SMALL = 1 << 24
_WHOLE = "decimal(38,0)"


def fixed_point(vector: str, scale: int = 64, offset: int = 1_000_000) -> Column:
    """``floor(scale * c) + offset`` of every entry; null for a vector that is null or has an entry that is null, not
    finite, or too large to be a whole number below 2^53."""
    c = lambda x: x.cast("double")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(c(x)) < float(EXACT // scale))
    whole = F.transform(vector, lambda x: F.floor(c(x) * F.lit(float(scale))) + F.lit(offset))
    return F.when(F.coalesce(F.forall(vector, good), F.lit(False)), whole)


@dataclass
class Model:
    """Of the vectors of one length: their number, the whole number next to the mean, what the differences from it
    sum up to, and the components as columns."""

    n: int
    base: np.ndarray
    rest: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def _pieces(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of one length as a matrix of whole numbers, in pieces of limited size."""
    for whole in batches:
        step = max(1, whole.num_rows * BATCH_BYTES // max(1, whole.nbytes))
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            sizes = pc.list_value_length(part.column(vector))
            for size in pc.unique(sizes).to_pylist():
                rows = part.filter(pc.equal(sizes, size))
                yield rows, rows.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, size)


def _add(rows: DataFrame, vector: str, of: Callable[[dict, np.ndarray], None]) -> DataFrame:
    """Sums over all rows of what ``of`` adds to a task's table of ``(length, i, j): number``."""
    schema = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, matrix in _pieces(batches, vector):
            of(sums, matrix)
        for length, table in sums.items():
            keys = [(i, j) for i in range(table.shape[0]) for j in range(table.shape[1])]
            columns = [[length] * len(keys), [k[0] for k in keys], [k[1] for k in keys]]
            parts = pa.array([str(x) for x in table.reshape(-1)]).cast(schema.field("part").type)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns] + [parts], schema=schema)

    made = rows.select(vector).mapInArrow(run, f"length int, i int, j int, part {_WHOLE}")
    return made.groupBy("length", "i", "j").agg(F.sum("part").alias("total"))


def _counts(sums: dict[int, np.ndarray], matrix: np.ndarray) -> None:
    """One row: how many vectors, then the sum of each dimension."""
    row = np.concatenate([[len(matrix)], matrix.sum(axis=0)]).astype(object)[None, :]
    size = matrix.shape[1]
    sums[size] = sums.get(size, 0) + row


def products(differences: np.ndarray) -> np.ndarray:
    """Exact sums of products of whole numbers, as Python's whole numbers."""
    most = int(np.abs(differences).max(initial=0))
    if most > SMALL:
        large = np.abs(differences).max(axis=1) > SMALL
        some = differences[large].astype(object)
        return some.T @ some + products(differences[~large])
    total = np.zeros((differences.shape[1],) * 2, dtype=object)
    step = EXACT // max(1, most * most)
    for at in range(0, len(differences), step):
        part = differences[at : at + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def fit(rows: DataFrame, vector: str, most: int = COMPONENTS) -> dict[int, Model]:
    """Models by length of the vectors (``array<bigint>``, nulls left out). No rows give none."""
    rows = rows.where(F.col(vector).isNotNull())
    sums: dict[int, dict[int, int]] = {}
    for r in _add(rows, vector, _counts).collect():  # as many rows as vectors have entries
        sums.setdefault(r["length"], {})[r["j"]] = int(r["total"])
    bases = {d: np.array([(2 * s[j] + s[0]) // (2 * s[0]) for j in range(1, d + 1)], dtype=np.int64) for d, s in sums.items()}

    def multiply(parts: dict[int, np.ndarray], matrix: np.ndarray) -> None:
        size = matrix.shape[1]
        if size:
            parts[size] = parts.get(size, 0) + products(matrix - bases[size])

    squares = {d: np.zeros((d, d), dtype=object) for d in sums if d}
    for r in _add(rows, vector, multiply).collect():  # a square as wide as the vectors are long
        squares[r["length"]][r["i"], r["j"]] = int(r["total"])
    models = {}
    for d, square in squares.items():
        n = sums[d][0]
        rest = [sums[d][j + 1] - n * int(bases[d][j]) for j in range(d)]
        exact = square * n - np.outer(np.array(rest, dtype=object), np.array(rest, dtype=object))
        covariance = np.array([[int(x) / (n * n) for x in line] for line in exact], dtype=np.float64)
        values, vectors = largest(covariance, most)
        trace = sum(int(exact[i, i]) for i in range(d)) / (n * n)
        models[d] = Model(n, bases[d], rest, trace, values, vectors)
    return models


def deviations(differences: np.ndarray, model: Model) -> list[int] | np.ndarray:
    """Exact sums of squares of ``n * x - S`` by row."""
    rest = np.array(model.rest, dtype=object)
    most = model.n * int(np.abs(differences).max(initial=0)) + max(map(abs, model.rest))
    if most * most * differences.shape[1] < 1 << 63:
        apart = differences * model.n - rest.astype(np.int64)
        return (apart * apart).sum(axis=1)
    apart = differences.astype(object) * model.n - rest
    return (apart * apart).sum(axis=1)


def project(rows: DataFrame, key: str, vector: str, models: dict[int, Model]) -> DataFrame:
    """``key, length, deviation, whitened``: one row per vector, ``whitened`` holds its number on each component."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, matrix in _pieces(batches, vector):
            size = matrix.shape[1]
            if size not in models:
                continue
            model = models[size]
            apart = matrix - model.base
            mean = np.array([r / model.n for r in model.rest])
            white = (apart - mean) @ model.vectors / np.sqrt(model.values)
            ends = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
            far = pa.array([str(x) for x in deviations(apart, model)]).cast(pa.decimal128(38, 0))
            columns = [part.column(key), pa.array(np.full(len(white), size), pa.int32()), far, pa.ListArray.from_arrays(ends, pa.array(white.reshape(-1)))]
            yield pa.RecordBatch.from_arrays(columns, [key, "length", "deviation", "whitened"])

    usable = rows.select(key, vector).where(F.col(vector).isNotNull())
    return usable.mapInArrow(run, f"{key} {kind}, length int, deviation {_WHOLE}, whitened array<double>")


def identity_errors(projected: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest difference, by length, between the covariance of ``whitened`` and the identity, from all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for length in pc.unique(batch.column("length")).to_pylist():
                rows = batch.filter(pc.equal(batch.column("length"), length))
                white = rows.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                white = np.hstack([np.ones((len(white), 1)), white])
                sums[length] = sums.get(length, 0) + white.T @ white
        for length, table in sums.items():
            i, j = (x.reshape(-1) for x in np.indices(table.shape))
            columns = [np.full(table.size, length, np.int32), i.astype(np.int32), j.astype(np.int32), table.reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "i", "j", "part"])

    sums = projected.select("length", "whitened").mapInArrow(run, "length int, i int, j int, part double")
    tables = {d: np.zeros((len(m.values) + 1,) * 2) for d, m in models.items()}
    for r in sums.groupBy("length", "i", "j").agg(F.sum("part").alias("total")).collect():  # squares of the components
        tables[r["length"]][r["i"], r["j"]] = r["total"]
    errors = {}
    for d, table in tables.items():
        mean, n = table[0, 1:] / models[d].n, models[d].n
        errors[d] = float(np.abs(table[1:, 1:] / n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    return errors


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "fixed", most: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    ``rows[vector]`` is ``array<bigint>``. Null vectors are left out and have no rows; so have empty vectors, and all
    vectors of a length whose covariance is zero (one vector, or equal ones). There are as many components as
    eigenvalues above ``feast.FLOOR`` of the largest, ``most`` at most. Repeated rows and null keys are rows like any
    other; other columns are ignored. ``n`` counts the vectors of the row's length.
    """
    models = fit(rows, vector, most)
    projected = stage(project(rows, key, vector, models), "whitened")
    errors = identity_errors(projected, models)
    facts = [
        (d, c, m.n, float(e / m.trace), errors[d]) for d, m in models.items() for c, e in enumerate(m.values, 1)
    ]  # as many rows as there are components
    known = rows.sparkSession.createDataFrame(facts, "length int, component int, n long, explained double, identity_error double")
    each = projected.select(key, "length", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    each = each.withColumn("component", F.col("at") + 1)
    names = (key, "component", "n", "deviation", "whitened", "explained", "identity_error")
    return each.join(F.broadcast(known), ["length", "component"]).select(*names)
