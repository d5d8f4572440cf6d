"""Mixing sources to target weights: complete epochs, then exponential keys up to the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Columns that mixing adds.
ADDED = ("size", "source_size", "target", "copies", "taken")
#: Weights given to sources in code-point order, repeating.
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
#: Weights up to this number (some 30 MB) are broadcast after a count, so that no text is shuffled for them; more are
#: joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes(source, source_size)`` with each source's ``target``.

    Targets share ``share`` times all sizes by weight; none is above ``most`` times its source's size, and
    what is cut off goes to the others by weight. This is one water level per unit of weight: with sources
    in the order in which a rising level fills them, the level left when all before a source are full
    rises as long as the next one overflows and falls from then on, so the level sought is the largest.
    The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.partitionBy()
    filling = Window.orderBy("fills_at", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(most))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("filled", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open"))
        .withColumn("water", F.max("level").over(whole))
    )
    target = F.least("most", F.col("water") * F.col("weight"))
    return levels.select(*sizes.columns, target.alias("target"))


def uniform(key: str) -> Column:
    """A number strictly between 0 and 1 from 52 bits of the key's MD5, the same in every run and in SQL."""
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = SOURCE_WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``.

    Every document of a source is taken floor(target / source size) times. The rest of the target is
    filled in the order of -ln(u) / w, where u is a fixed random number of the key and w the document's
    quality weight from ``quality(key, weight)`` (1 where it has none; repeated keys take the largest; a
    weight that is not positive sends the document to the end). A document is taken while the sum up to
    its middle is within the budget, so the sum ends at most half a document off.

    The order is cut into buckets, about the square root of the source's rows. Bucket sums show in which
    bucket the budget ends, and only that bucket is sorted, so that no task sees a whole source. What is
    decided is one row per source, which is written to the shared folder and joined back.

    Null text has size 0; a null source is a source of its own; a source without words has target 0.
    Columns of ``docs`` named like the new ones are replaced. Rows equal in key, source and size are
    decided as one; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(
        F.struct(*names).alias("row"),
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    ordered = _with_order(rows, key, quality)
    budgets = _budgets(rows, weights, share, most)
    cuts = _cuts(_in_buckets(ordered.drop("row"), budgets))
    decided = _in_buckets(ordered, budgets).alias("r").join(
        cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left"
    )
    at_cut = F.struct("r.order", "r.key", "r.size") <= F.col("c.last")
    picked = (F.col("bucket") < F.col("c.cut")) | ((F.col("bucket") == F.col("c.cut")) & F.coalesce(at_cut, F.lit(False)))
    copies = (F.col("epochs") + F.coalesce(picked, F.lit(False)).cast("long")).alias("copies")
    return decided.select("r.row", "r.size", "source_size", "target", copies).select(
        "row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _with_order(rows: DataFrame, key: str, quality: DataFrame | None) -> DataFrame:
    """``rows`` with the sampling order: smaller comes first."""
    weight = F.lit(1.0)
    if quality is not None:
        best = quality.select(F.col(key).alias("key"), F.col("weight").cast("double").alias("weight"))
        best = best.where("key is not null").groupBy("key").agg(F.max("weight").alias("weight"))
        best = stage(best.where("weight <> 1"), "weights")  # the others are as good as not there
        best = F.broadcast(best) if best.count() <= BROADCAST_KEYS else best
        rows, weight = rows.join(best, "key", "left"), F.coalesce("weight", F.lit(1.0))
    order = F.when(weight > 0, -F.log(uniform("key")) / weight).otherwise(F.lit(float("inf")))
    return rows.withColumn("order", order).drop("weight")


def _budgets(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: its size, target, complete epochs, the words left to pick and its number of buckets."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(totals, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    found = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    return stage(found.withColumn("buckets", F.ceil(F.sqrt("n")).cast("long")).drop("n"), "budgets")


def _in_buckets(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Budgets joined to the rows, which are numbered by bucket along the order (even for weight 1)."""
    bucket = F.floor((1 - F.exp(-F.col("order"))) * F.col("buckets"))
    joined = rows.alias("r").join(budgets.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")))
    return joined.drop(F.col("b.source")).withColumn("bucket", bucket)


def _cuts(rows: DataFrame) -> DataFrame:
    """One row per source: the bucket ``cut`` in which its budget ends and the ``last`` picked there."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.first("budget").alias("limit"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("sum", F.sum("held").over(upto)).withColumn("over", F.col("sum") > F.col("limit"))
    ends = ends.groupBy("source").agg(
        F.coalesce(F.min(F.when(F.col("over"), F.col("bucket"))), F.max("bucket") + 1).alias("cut"),
        F.coalesce(F.max(F.when(~F.col("over"), F.col("sum"))), F.lit(0)).alias("before"),
    )
    ends = stage(ends, "cuts")
    here = F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.cut"))
    split = rows.alias("r").join(ends.alias("e"), here).drop(F.col("e.source"))
    same = split.groupBy("source", "order", "key", "size").agg(
        F.sum("size").alias("unit"), F.first("before").alias("before"), F.first("budget").alias("limit")
    )
    running = Window.partitionBy("source").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("unit").over(running), F.lit(0))
    fits = same.withColumn("fits", start + F.col("unit") / 2 <= F.col("limit"))
    last = fits.groupBy("source").agg(F.max(F.when(F.col("fits"), F.struct("order", "key", "size"))).alias("last"))
    joined = ends.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left")
    return stage(joined.select("e.source", "e.cut", "l.last"), "cuts")
