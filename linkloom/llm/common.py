"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import BATCH_BYTES, bound_batches, stage

#: Entries a Python worker keeps for words it has already seen; the memo is emptied when full.
MEMO_ENTRIES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's decimal text modulo ``parts``: the fixed split into learning and held-out rows."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def spread_order(key: str) -> Column:
    """A fixed pseudo-random number in [0, 1) for a row's key, the same in every run."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def map_batches(rows: DataFrame, transform: Callable[[], Callable[[pa.RecordBatch], list[list]]], schema: str) -> DataFrame:
    """Rows made from parts of each Arrow batch; ``transform()`` is called once per task and returns the batch
    function, which gives one list of values per output column.

    Batches are limited in bytes on their way to the workers too: both ends hold a whole one.
    """
    bound_batches(rows.sparkSession)
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = transform()
        for whole in batches:
            rows = max(1, whole.num_rows * BATCH_BYTES // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                columns = [pa.array(values, type=field.type) for values, field in zip(step(batch), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        pa.default_memory_pool().release_unused()  # a worker lives on and would keep the most it ever held

    return rows.mapInArrow(run, fields)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node that has an edge.

    ``edges(a, b)`` holds links between comparable ids. A node's label is a member of its component that is no larger.
    In a round every label learns the smallest label that a neighbour of any node under it has, so whole trees are
    hooked to smaller ones whatever way the ids run along a path, and then labels are followed until they are
    roots. At least every other tree of a component that is not yet one is hooked in a round, so n nodes need about
    log n rounds. A round is written to the shared folder, which cuts the lineage in a way that outlives executors.
    Repeated edges, loops and both directions are allowed; no edges give no rows. Returns ``node, root``.
    """
    return labelled(edges)[0]


def labelled(edges: DataFrame) -> tuple[DataFrame, int]:
    """``components`` and the number of rounds it took."""
    open_edges = stage(edges.select("a", "b").where("a <> b").distinct(), "links")
    both = open_edges.union(open_edges.select("b", "a")).toDF("a", "b")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    labels, rounds = _followed(labels), 0
    while True:
        # Between trees only: an edge whose ends have one root is settled and leaves the table for good.
        ends = open_edges.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").where("x <> y")
        open_edges = stage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "open-links")
        if open_edges.isEmpty():
            return labels.select("node", F.col("label").alias("root")), rounds
        rounds += 1
        between = open_edges.union(open_edges.select("b", "a")).toDF("a", "b")
        hooks = between.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        hooks = hooks.select("node", F.least("node", "near").alias("label"))
        # A root that is smaller than all its neighbours stays; the others hang below one of theirs.
        roots = _followed(stage(hooks, "hooks"))
        moved = labels.join(roots.toDF("label", "root"), "label", "left")
        labels = stage(moved.select("node", F.coalesce("root", "label").alias("label")), "labels")


def _followed(labels: DataFrame) -> DataFrame:
    """Every label replaced by the label of its label until that is its own: paths halve in each step."""
    while True:
        above = labels.toDF("label", "next")
        moved = labels.join(above, "label", "left").select("node", F.coalesce("next", "label").alias("label"), F.col("label").alias("was"))
        moved = stage(moved, "followed")
        if moved.where("label <> was").isEmpty():
            return labels
        labels = moved.select("node", "label")
