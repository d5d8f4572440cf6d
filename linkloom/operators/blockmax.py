"""Ranked search that reads only the blocks of an index that can still hold a result.

Bookmarks are numbered by length and cut into blocks, so a block holds rows of about one length. For every
prefix of an indexed word a block keeps how many of its rows match, the largest number of matching tokens
in a row, and the shortest matching row. That bounds any score in the block from above, and the numbers
of rows add up to the exact document frequency of the prefix. A query reads blocks from the largest bound
down and stops when no unread block can reach the ``k``-th best score found.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import query_tokens
from ..schema import INDEXED_FIELDS
from ..session import bound_batches, observed, stage
from .fulltext import CANDIDATES, IDF_FLOOR, lead, prefix_filter, put_together, term_score, token_texts
from .numbering import numbered
from .wordcounts import PACKED, PREFIX_CHARS, PREFIX_COUNTS, WORD_COUNTS, Cuts, count_prefixes, count_words, unpacked

#: Rows of a block. Smaller blocks bound tighter and make more block rows.
BLOCK_ROWS = 1024
#: Tokens whose prefixes one task counts while an index is built.
TASK_TOKENS = 1_000_000
#: Tokens whose words or prefixes lie in one range, as far as that; small tables get a range per task slot.
RANGE_TOKENS = 2_000_000
MIN_RANGE_TOKENS = 100_000
#: Tokens, and least number of blocks, from which the cuts between ranges are learnt.
SAMPLE_TOKENS = 1_000_000
SAMPLE_BLOCKS = 8
#: Blocks read in the first round; every further round reads twice as many.
FIRST_BLOCKS = 8
#: Blocks named one by one in a scan filter; more are joined.
NAMED_BLOCKS = 1000
#: Room for rounding when a bound is compared with a score.
SLACK = 1e-9


@dataclass
class BlockIndex:
    """``postings(term, id, field, tf, length, lead, block)`` and ``blocks(lead, prefix, block, rows, max_freq,
    min_length)``; postings of ``stale`` ids do not count, ``recent`` ones belong to no block and always do."""

    postings: DataFrame
    blocks: DataFrame
    stale: DataFrame | None = None
    recent: DataFrame | None = None


@dataclass
class Report:
    """What a search read: per round ``(blocks, posting rows)``, and the blocks that hold all terms.

    A round without any match counts no rows, see ``session.observed``.
    """

    candidates: int = 0
    rounds: list[tuple[int, int]] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(rows for _, rows in self.rounds)


def block_tokens(bookmarks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``fulltext.token_rows`` with ``block``."""
    return blocked(stage(token_texts(bookmarks), "texts"), block_rows)


def blocked(texts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``put_together`` of staged ``token_texts``, with ``block``. Only ids and lengths are numbered, so no text travels for that."""
    lengths = numbered(texts.select("id", "length").distinct(), [F.col("length"), F.col("id")], "block")
    blocks = lengths.select("id", "length", F.floor(F.col("block") / block_rows).cast("int").alias("block"))
    return put_together(texts).join(blocks, ["id", "length"])


def block_postings(tokens: DataFrame) -> DataFrame:
    """``postings`` with ``lead`` and ``block`` of staged block tokens, in partitions that are ranges of term and block."""
    rows = tokens.filter("length > 0").select("id", "length", "block", *INDEXED_FIELDS)

    def counted(rows: DataFrame, size: int, cuts: Cuts) -> DataFrame:
        return rows.mapInArrow(count_words(cuts), PACKED)

    return _ranges(rows, counted, WORD_COUNTS).withColumn("lead", lead(F.col("term")))


def prefix_blocks(tokens: DataFrame) -> DataFrame:
    """``(lead, prefix, block, rows, max_freq, min_length)`` of staged block tokens, in partitions that are ranges of
    prefix and block.

    Texts are dealt by block, and a block is counted to the end where it lies. A task gets some ``TASK_TOKENS`` tokens,
    whatever the table holds.
    """
    text = F.concat_ws(" ", *[F.nullif(F.col(f), F.lit("")) for f in INDEXED_FIELDS]).alias("text")
    rows = tokens.filter("length > 0").select("block", "id", "length", text)

    def counted(rows: DataFrame, size: int, cuts: Cuts) -> DataFrame:
        dealt = rows.repartition(1 + size // TASK_TOKENS, "block").sortWithinPartitions("block", "id")
        return dealt.mapInArrow(count_prefixes(cuts), PACKED)

    found = _ranges(rows, counted, PREFIX_COUNTS)
    return found.select(lead(F.col("prefix")).alias("lead"), "prefix", "block", "rows", "max_freq", "min_length")


def _ranges(rows: DataFrame, counted: Callable[[DataFrame, int, Cuts], DataFrame], schema: str) -> DataFrame:
    """What ``counted`` packs of ``rows`` (of some number of tokens), unpacked in one partition for each range.

    Where ranges are cut is learnt from some blocks in equal distances, so that nothing is counted twice for it.
    A shuffle by range of Spark's own would count everything once more to sample it.
    """
    bound_batches(rows.sparkSession)
    size = rows.agg(F.sum(F.col("length").cast("bigint")).alias("n"), F.min("block").alias("first"), F.max("block").alias("last")).first()
    total = size.n or 0
    slots = rows.sparkSession.sparkContext.defaultParallelism
    n = 1 + max(total // RANGE_TOKENS, min(slots - 1, total // MIN_RANGE_TOKENS))
    cuts: Cuts = []
    if n > 1:
        step = max(1, min(total // SAMPLE_TOKENS, (size.last - size.first) // SAMPLE_BLOCKS))
        some = rows.filter((F.col("block") - size.first) % step == step // 2)
        some = counted(some, total // step, []).mapInArrow(unpacked, schema)
        some = stage(some.select(F.col(some.columns[0]).alias("name"), "block"), "sample")
        parts = some.repartitionByRange(n, "name", "block").groupBy(F.spark_partition_id()).agg(F.min(F.struct("name", "block")))
        cuts = sorted((first.name, first.block) for _, first in parts.collect())[1:]
    return counted(rows, total, cuts).repartitionById(len(cuts) + 1, F.col("range")).mapInArrow(unpacked, schema)


def _frequencies(index: BlockIndex, bounds: DataFrame, terms: list[str]) -> list[int]:
    """Rows that match each term. Only the stale, the recent and the very long terms need postings."""
    short = {r["prefix"]: r["n"] for r in bounds.groupBy("prefix").agg(F.sum("rows").alias("n")).collect()}
    found = [0 if len(t) > PREFIX_CHARS else short.get(t, 0) for t in terms]
    long = [len(t) > PREFIX_CHARS for t in terms]

    def add(rows: DataFrame, sign: int, which: list[bool]) -> None:
        counters = [F.count_distinct(F.when(F.col("term").startswith(t), F.col("id"))).alias(f"n{i}") for i, t in enumerate(terms)]
        counts = prefix_filter(rows, [t for t, w in zip(terms, which) if w]).agg(*counters).first()
        for i, wanted in enumerate(which):
            found[i] += sign * counts[f"n{i}"] if wanted else 0

    every = [True] * len(terms)
    if any(long):
        add(index.postings, 1, long)
    if index.stale is not None and not index.stale.isEmpty():
        add(index.postings.join(index.stale.select("id"), "id", "left_semi"), -1, every)
    if index.recent is not None:
        add(index.recent, 1, every)
    return found


def _candidates(bounds: DataFrame, terms: list[str], weights: list[float], mean_length: float) -> DataFrame:
    """``(block, bound)`` of the blocks that hold every term."""
    prefixes = [t[:PREFIX_CHARS] for t in terms]
    freqs = [F.max(F.when(F.col("prefix") == p, F.col("max_freq"))).alias(f"f{i}") for i, p in enumerate(prefixes)]
    per_block = bounds.groupBy("block").agg(*freqs, F.max("min_length").alias("length"))
    parts = [
        term_score(F.lit(w), F.col(f"f{i}").cast("double"), F.col("length"), F.lit(mean_length)) for i, w in enumerate(weights)
    ]
    return per_block.select("block", reduce(Column.__add__, parts).alias("bound")).filter(F.col("bound").isNotNull())


def _scored(rows: DataFrame, terms: list[str], weights: list[float], mean_length: float) -> DataFrame:
    """``(id, score)`` of the rows that match every term."""
    sums = [F.sum(F.when(F.col("term").startswith(t), F.col("tf")).otherwise(0)).alias(f"f{i}") for i, t in enumerate(terms)]
    counted = rows.groupBy("id").agg(F.max("length").alias("length"), *sums)
    matched = counted.filter(reduce(Column.__and__, [F.col(f"f{i}") > 0 for i in range(len(terms))]))
    parts = [
        term_score(F.lit(w), F.col(f"f{i}").cast("double"), F.col("length"), F.lit(mean_length)) for i, w in enumerate(weights)
    ]
    return matched.select("id", reduce(Column.__add__, parts).alias("score"))


def search_blockmax(
    index: BlockIndex, stats: DataFrame, hidden_ids: DataFrame, query: str, limit: int = CANDIDATES
) -> tuple[DataFrame, Report]:
    """``(id, score, rank)`` of ``fulltext.search_index`` over all fields, and what was read for it.

    Each round is a job over the postings of some blocks; ``limit`` rows and the names of the round's
    blocks reach the driver. ``stats`` is one row of ``n, mean_length``.
    """
    spark, report = index.postings.sparkSession, Report()
    schema = "id string, score double, rank int"
    terms = query_tokens(query)
    if not terms:
        return spark.createDataFrame([], schema), report
    prefixes = sorted({t[:PREFIX_CHARS] for t in terms})
    leads = sorted({t[0] if t[0].isascii() else "_" for t in terms})
    bounds = stage(index.blocks.filter(F.col("lead").isin(leads) & F.col("prefix").isin(prefixes)), "bounds")
    corpus = stats.select("n", "mean_length").first()
    weights = []
    for df in _frequencies(index, bounds, terms):
        raw = math.log((corpus.n - df + 0.5) / (df + 0.5))
        weights.append(raw if raw > 0 else IDF_FLOOR)
    mean = corpus.mean_length or 0.0
    found: list[tuple[str, float]] = []

    def read(rows: DataFrame, blocks: int, unwanted: DataFrame) -> None:
        seen = Observation()
        hits = prefix_filter(rows, terms).observe(seen, F.count("*").alias("rows"))
        best = _scored(hits, terms, weights, mean).join(unwanted, "id", "left_anti")
        best = best.orderBy(F.col("score").desc(), "id").limit(limit).collect()
        report.rounds.append((blocks, observed(seen, ["rows"])["rows"]))
        found[:] = sorted([*found, *((r.id, r.score) for r in best)], key=lambda r: (-r[1], r[0]))[:limit]

    hidden = hidden_ids.select("id")
    gone = hidden if index.stale is None else hidden.union(index.stale.select("id"))
    if index.recent is not None:
        read(index.recent, 0, hidden)
    blocks = stage(_candidates(bounds, terms, weights, mean), "candidates")
    report.candidates = blocks.count()
    left, size = blocks, FIRST_BLOCKS
    while True:
        if len(found) == limit:
            left = left.filter(F.col("bound") >= found[-1][1] * (1 - SLACK))
        chosen = left.orderBy(F.col("bound").desc(), "block").limit(size).collect()
        if not chosen:
            break
        names = [r.block for r in chosen]
        if len(names) <= NAMED_BLOCKS:
            rows = index.postings.filter(F.col("block").isin(names))
        else:
            rows = index.postings.join(F.broadcast(spark.createDataFrame([(b,) for b in names], "block int")), "block", "left_semi")
        read(rows, len(names), gone)
        last = chosen[-1]
        left = blocks.filter((F.col("bound") < last.bound) | ((F.col("bound") == last.bound) & (F.col("block") > last.block)))
        size = min(2 * size, 64 * NAMED_BLOCKS)
    return spark.createDataFrame([(i, s, n) for n, (i, s) in enumerate(found, 1)], schema), report
