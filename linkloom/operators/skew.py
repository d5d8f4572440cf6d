"""Plan shapes shared by the operators: joins on hot keys, and costly columns computed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16

# A lookup up to this many narrow rows is counted first and then broadcast.
BROADCAST_ROWS = 200_000

# Ids or urls up to this number (some 200 MB in a hash table) are broadcast, so that the texts they choose stay where they lie.
FEW_KEYS = 2_000_000


def near_keys(keys: DataFrame) -> tuple[DataFrame, bool]:
    """Keys that are cheap to count, marked for broadcast if they are few, and whether they are."""
    few = keys.count() <= FEW_KEYS
    return (F.broadcast(keys) if few else keys), few


def sized_join(rows: DataFrame, lookup: DataFrame, on: str | list[str], spread: str) -> DataFrame:
    """Join to a ``lookup`` that is cheap to count: broadcast when short, salted otherwise."""
    if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), on)
    return salted_join(rows, lookup, on, spread)


def salted_join(
    rows: DataFrame, lookup: DataFrame, on: str | list[str], spread: str, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join ``rows`` (any key may hold a large share of them) to ``lookup`` (few rows per key).

    Rows of one key are spread over ``salts`` partitions by the hash of ``spread``; each lookup
    row is repeated once per salt. When the lookup turns out small, adaptive execution replaces
    the shuffle by a broadcast on its measured size and the salt costs nothing.
    """
    keys = [on] if isinstance(on, str) else list(on)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    right = lookup.withColumn("_salt", F.explode(every))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def computed_once(rows: DataFrame, keep: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus ``columns``, each evaluated a single time per row.

    A filter on a projected column is pushed below the projection, which repeats the column's
    whole expression in the filter. For costly text expressions that is the wrong trade; a filter
    does not pass a generator, so the columns come out of a one-row ``inline``.
    """
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
