"""Building and maintaining the stored full-text index.

``postings`` is one large table sorted by term. A change of some bookmarks does not rewrite it:
their ids go to ``stale_ids``, which hides their old postings, and their new postings go to
``postings_recent``, bucketed by id. Building the index again folds both back in. ``prefix_blocks``
bounds the scores of each block of ``postings``, and ``corpus_parts`` holds one row of sums per bucket
of ``doc_lengths``, replaced together with its bucket, so no search reads the lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blockmax, catalog, fulltext, quantised
from ..operators.listing import read_state
from ..operators.skew import near_keys
from ..schema import BOOKMARK_COLUMNS, INDEXED_FIELDS
from ..session import stage
from ..sources.tables import DEALT, Parts, Ranges, TableStore

INDEX_VERSION_KEY = "index_version"

# Changes whenever the indexed columns, the token rules or the layout change.
INDEX_VERSION = "2:" + ",".join(INDEXED_FIELDS)


def index_rows(bookmarks: DataFrame) -> DataFrame:
    rows = fulltext.postings(bookmarks)
    return rows.withColumn("lead", fulltext.lead(F.col("term")))


def corpus_parts(store: TableStore, lengths: DataFrame) -> DataFrame:
    """``(part, n, total_length)``: what each bucket of ``doc_lengths`` adds up to."""
    part = store.bucket_of("doc_lengths").alias("part")
    return lengths.groupBy(part).agg(F.count("*").alias("n"), F.sum("length").cast("bigint").alias("total_length"))


def corpus_stats(parts: DataFrame) -> DataFrame:
    """One row of ``n, mean_length`` from the parts."""
    n, total = F.sum("n").cast("double"), F.sum("total_length").cast("double")
    return parts.agg(F.coalesce(n, F.lit(0.0)).alias("n"), (total / n).alias("mean_length"))


def is_current(store: TableStore) -> bool:
    return read_state(store.read("sync_state"), INDEX_VERSION_KEY).first().value == INDEX_VERSION


def build_index(store: TableStore, batch_id: str, block_rows: int = blockmax.BLOCK_ROWS) -> int:
    """Index every bookmark, hidden ones included. Page text is not read."""
    bookmarks = store.read("bookmarks")
    # Texts are cut into words once; all that follows reads these.
    texts = stage(fulltext.token_texts(bookmarks), "texts")
    tokens = stage(blockmax.blocked(texts, block_rows), "tokens")
    lengths = texts.select("id", "length")
    version = store.spark.createDataFrame([(INDEX_VERSION_KEY, INDEX_VERSION)], "key string, value string")
    changes = {
        "postings": Ranges(blockmax.block_postings(tokens)),
        "prefix_blocks": Ranges(blockmax.prefix_blocks(tokens)),
        "postings_recent": store.empty("postings_recent"),
        "stale_ids": store.empty("stale_ids"),
        "doc_lengths": lengths,
        "corpus_parts": corpus_parts(store, lengths),
        "sync_state": catalog.put_state(store.read("sync_state"), version),
    }
    return store.commit(batch_id, changes)


def ensure_index(store: TableStore, batch_id: str) -> None:
    """Rebuild when the stored index was made for other columns or rules."""
    if not is_current(store):
        build_index(store, batch_id)


def live_postings(base: DataFrame, recent: DataFrame, stale_ids: DataFrame) -> DataFrame:
    return catalog.delete_ids(base, stale_ids).unionByName(recent)


def recent_postings(recent: DataFrame, changed_ids: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Recent postings after the bookmarks of ``changed_ids`` were inserted, changed or deleted.

    ``bookmarks`` holds the next state of at least these rows; ids it lacks leave the index.
    """
    now = bookmarks.join(changed_ids.select("id").distinct(), "id", "left_semi").select(*BOOKMARK_COLUMNS)
    rows = index_rows(now).withColumn("block", F.lit(None).cast("int"))
    return catalog.delete_ids(recent, changed_ids).unionByName(rows.select(*recent.columns))


def dealt_postings(bookmarks: DataFrame, ids: DataFrame | None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """What is dealt for the postings of bookmarks, those of ``ids`` if given, and what makes the postings of it.

    Tokens are dealt by id, as short as they are, and become postings behind the shuffle; ``ids`` are dealt with them.
    """
    tokens = fulltext.token_texts(bookmarks)
    if ids is not None:
        tokens = tokens.withColumn("_wanted", F.lit(False)).unionByName(ids.withColumn("_wanted", F.lit(True)), allowMissingColumns=True)

    def made(dealt: DataFrame) -> DataFrame:
        if ids is not None:
            named = dealt.withColumn("_named", F.bool_or("_wanted").over(Window.partitionBy(*DEALT, "id")))
            dealt = named.filter(F.col("_named") & ~F.col("_wanted")).drop("_named", "_wanted")
        rows = fulltext.postings_of(fulltext.put_together(dealt, DEALT))
        return rows.withColumns({"lead": fulltext.lead(F.col("term")), "block": F.lit(None).cast("int")})

    return tokens, made


def changes_for(
    store: TableStore, changed_ids: DataFrame, bookmarks: DataFrame
) -> tuple[dict[str, DataFrame | Parts], dict[str, list[int]]]:
    """Table changes and touched buckets that bring the index up to date for ``changed_ids``."""
    ids = stage(changed_ids.select("id").distinct(), "ids")
    buckets = store.touched("doc_lengths", ids)
    near, few = near_keys(ids)
    # Texts are cut to the changed ids where they lie, or else after their words were counted.
    now = bookmarks.join(near, "id", "left_semi") if few else bookmarks
    counted = fulltext.doc_lengths(now) if few else fulltext.doc_lengths(bookmarks).join(ids, "id", "left_semi")
    lengths = stage(store.read("doc_lengths", buckets).join(near, "id", "left_anti").unionByName(counted), "lengths")
    kept = store.read("postings_recent", buckets).join(near, "id", "left_anti")
    kept = kept if few else store.deal("postings_recent", kept)
    changes = {
        "postings_recent": Parts(kept, *dealt_postings(now, None if few else ids)),
        "stale_ids": store.read("stale_ids", buckets).union(ids).distinct(),
        "doc_lengths": lengths,
        "corpus_parts": corpus_parts(store, lengths),
    }
    return changes, dict.fromkeys(changes, buckets)


def with_codes(changes: dict[str, DataFrame], touched: dict[str, list[int]] | None = None) -> None:
    """Adds the codes of changed vectors to a commit, for the same buckets."""
    if "vectors" in changes:
        changes["vector_codes"] = quantised.codes(changes["vectors"])
        if touched and "vectors" in touched:
            touched["vector_codes"] = touched["vectors"]


def update_index(store: TableStore, changed_ids: DataFrame, batch_id: str) -> int:
    """Bring the index up to date for some stored bookmarks."""
    changes, touched = changes_for(store, changed_ids, store.read("bookmarks"))
    return store.commit(batch_id, changes, touched)


def fold_in(store: TableStore, batch_id: str, share: float = 0.1) -> bool:
    """Build the index again once more than ``share`` of the bookmarks have recent postings or masked old ones.

    Searches read recent postings whole and check old ones against the masked ids, so both must stay a small
    part; a rebuild empties them. Returns whether one was made.
    """
    total = corpus_stats(store.read("corpus_parts")).first().n
    masked = store.read("stale_ids").count()
    if not is_current(store) or masked <= share * total:
        return False
    build_index(store, batch_id)
    return True


def open_index(store: TableStore) -> tuple[DataFrame, DataFrame]:
    """``(postings, corpus_stats)`` as the search jobs take them."""
    live = live_postings(store.read("postings"), store.read("postings_recent"), store.read("stale_ids"))
    return live, corpus_stats(store.read("corpus_parts"))


def open_blocks(store: TableStore) -> tuple[blockmax.BlockIndex, DataFrame]:
    """``(block index, corpus_stats)`` for searches that read the blocks they need."""
    tables = [store.read(name) for name in ("postings", "prefix_blocks", "stale_ids", "postings_recent")]
    return blockmax.BlockIndex(*tables), corpus_stats(store.read("corpus_parts"))
