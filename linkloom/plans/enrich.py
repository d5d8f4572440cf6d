"""Enrichment: page text, title, summary, keywords and embedding of waiting rows.

``enrich_rows`` is one lineage over the whole queue. The jobs below write its result once before
using it, because the model calls must not run again for the second table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import models
from ..functions.prompts import PROMPT_BYTES, parse_response, render_prompt
from ..functions.text import EMBED_BYTES, SCRAPE_BYTES, byte_cap, is_url_only_title, text_to_embed, title_from_content
from ..operators import catalog, listing
from ..operators.answers import AnswerBook
from ..schema import BOOKMARK_COLUMNS, FAILED, PENDING, SUCCESS
from ..session import observed, stage, timestamp
from ..sources.tables import NEWER, TableStore
from . import index as index_plan

QUEUE, REPROCESS, MANUAL = "queue", "reprocess", "manual"

# How a row left a run.
FETCH_FAILED, MODEL_FAILED = "fetch_failed", "model_failed"

@dataclass(frozen=True)
class Limits:
    """Bytes after which page texts, the page text in a prompt, and embedded texts are cut; None: never."""

    scrape_bytes: int | None = None
    prompt_bytes: int | None = None
    embed_bytes: int | None = None


#: Limits for models and stores that take short texts only.
SHORT = Limits(SCRAPE_BYTES, PROMPT_BYTES, EMBED_BYTES)


def title_is_stale(mode: str) -> Column:
    """Whether page text may replace the title; each entry point has its own rule."""
    from_x = (F.col("source") == "x") & is_url_only_title(F.col("title"))
    if mode == QUEUE:
        bare = (F.coalesce(F.col("title"), F.lit("")) == "") | (F.col("title") == F.col("url"))
        return ((F.col("source") == "manual") & bare) | from_x
    if mode == REPROCESS:
        return (F.col("source") != "x") | from_x
    if mode == MANUAL:
        return F.lit(True)
    raise ValueError(f"unknown mode: {mode}")


def refreshed_title(mode: str, content: Column) -> Column:
    return F.when(title_is_stale(mode), title_from_content(content, F.col("title"))).otherwise(F.col("title"))


def page_texts(snapshot: DataFrame, urls: DataFrame) -> DataFrame:
    """Newest ``(url, content)`` of the wanted urls from a crawl of ``(url, content, seq)``.

    The crawl is cut to the wanted urls first; copies of a page are then folded map-side.
    """
    wanted = snapshot.join(urls.select("url").distinct(), "url", "left_semi")
    return wanted.groupBy("url").agg(F.max_by("content", "seq").alias("content"))


def acquire(
    rows: DataFrame, snapshot: DataFrame | None = None, fetcher: models.Model | None = None, scrape_bytes: int | None = None
) -> DataFrame:
    """Fill blank ``raw_content`` from a crawl snapshot or a fetcher; adds ``fetched``.

    Rows that already have page text are neither joined nor fetched. ``scrape_bytes`` cuts new page texts.
    """
    blank = F.coalesce(F.col("raw_content"), F.lit("")) == ""
    have = rows.filter(~blank).withColumn("fetched", F.lit(True))
    need = rows.filter(blank)
    if fetcher is not None:
        got = need.withColumn("content", models.apply_model(fetcher, F.col("url"), "string"))
    elif snapshot is not None:
        got = need.join(page_texts(snapshot, need), "url", "left")
    else:
        raise ValueError("page text needs a snapshot or a fetcher")
    filled = got.withColumns(
        {
            "raw_content": F.coalesce(_capped(F.col("content"), scrape_bytes), F.lit("")),
            "fetched": F.col("content").isNotNull(),
        }
    )
    return have.unionByName(filled.select(*have.columns))


def _capped(text: Column, limit: int | None) -> Column:
    return text if limit is None else byte_cap(text, limit)


def _named(model: str | models.Model) -> str:
    """What a model's answers are kept under: its name, or where its code is defined."""
    return model if isinstance(model, str) else f"{model.__module__}.{getattr(model, '__qualname__', type(model).__qualname__)}"


def summarize(
    rows: DataFrame,
    wanted: Column,
    model: str | models.Model,
    prompt: str | None = None,
    prompt_bytes: int | None = None,
    book: AnswerBook | None = None,
) -> DataFrame:
    """Add ``asked`` and ``answer`` (struct of summary, keywords, raw_response; NULL on failure).

    ``prompt_bytes`` cuts the page text in the prompt; with a ``book`` only new prompts reach the model, and ``rows`` are numbered by it.
    """
    text = F.when(F.col("asked"), render_prompt(F.col("raw_content"), prompt, prompt_bytes))
    asked = rows.withColumn("asked", wanted)
    chosen = models.summary_model(model)
    if book is None:
        asked = asked.withColumn("_prompt", text)
        response = asked.withColumn("response", models.apply_model(chosen, F.col("_prompt"), "string")).drop("_prompt")
    else:
        response = book.ask(asked, text, "response", chosen, _named(model), "string")
    answer = F.when(F.col("response").isNotNull(), parse_response(F.col("response")))
    return response.withColumn("answer", answer).drop("response")


def embed(
    rows: DataFrame, wanted: Column, model: str | models.Model | None, embed_bytes: int | None = None, book: AnswerBook | None = None
) -> DataFrame:
    """Add ``embedded_text_hash`` and ``embedding``; both NULL where no embedding was made.

    ``embed_bytes`` cuts the embedded text; with a ``book`` only new texts reach the model, and ``rows`` are numbered by it.
    """
    chosen = models.embedder(model)
    if chosen is None:
        return rows.withColumns(
            {"embedding": F.lit(None).cast("array<float>"), "embedded_text_hash": F.lit(None).cast("string")}
        )
    text = F.when(wanted, _capped(text_to_embed(F.col("title"), F.col("summary"), F.col("keywords")), embed_bytes))
    if book is None:
        done = rows.withColumn("_text", text)
        done, text = done.withColumn("embedding", models.apply_model(chosen, F.col("_text"), "array<float>")), F.col("_text")
    else:
        done = book.ask(rows, text, "embedding", chosen, _named(model), "array<float>")
    made = F.when(F.col("embedding").isNotNull(), F.sha2(text, 256))
    return done.withColumn("embedded_text_hash", made).drop("_text")


def enrich_rows(
    queue: DataFrame,
    batch_time: str | Column,
    snapshot: DataFrame | None = None,
    fetcher: models.Model | None = None,
    summary_model: str | models.Model = "lead",
    embedder: str | models.Model | None = "hash",
    prompt: str | None = None,
    mode: str = QUEUE,
    limits: Limits | None = None,
    book: AnswerBook | None = None,
) -> DataFrame:
    """The queue after one run: bookmark columns, embedding columns and ``outcome``.

    * no page text: ``failed`` (a manual row stays as it is), nothing else changes;
    * summary asked for only while blank; a model error is tolerated, except when reprocessing,
      where it leaves the row blank and pending;
    * otherwise ``success`` and a new scrape time, with or without summary and embedding.

    Texts are cut only where ``limits`` says so. With a ``book`` models are asked for new texts only.
    """
    now, limits = timestamp(batch_time), limits or Limits()
    rows = acquire(queue.select(*BOOKMARK_COLUMNS), snapshot, fetcher, limits.scrape_bytes).withColumn("old_title", F.col("title"))
    rows = rows.withColumn(
        "title", F.when(F.col("fetched"), refreshed_title(mode, F.col("raw_content"))).otherwise(F.col("title"))
    )
    rows = book.numbered(rows) if book else rows
    no_summary = F.coalesce(F.col("summary"), F.lit("")) == ""
    rows = summarize(rows, F.col("fetched") & no_summary, summary_model, prompt, limits.prompt_bytes, book)
    answered = F.col("asked") & F.col("answer").isNotNull()
    keep_keywords = F.lit(mode == QUEUE) & (F.coalesce(F.col("keywords"), F.lit("")) != "")
    aborted = F.lit(mode == REPROCESS) & F.col("asked") & F.col("answer").isNull()
    outcome = F.when(~F.col("fetched"), FETCH_FAILED).when(aborted, MODEL_FAILED).otherwise(SUCCESS)
    rows = rows.withColumns(
        {
            "summary": F.when(answered, F.col("answer.summary")).otherwise(F.col("summary")),
            "keywords": F.when(answered & ~keep_keywords, F.col("answer.keywords")).otherwise(F.col("keywords")),
            "outcome": outcome,
        }
    )
    rows = embed(rows, F.col("outcome") == SUCCESS, embedder, limits.embed_bytes, book)
    failed, undone = F.col("outcome") == FETCH_FAILED, F.col("outcome") == MODEL_FAILED
    untouched = failed & F.lit(mode == MANUAL)
    missed = PENDING if mode == MANUAL else FAILED
    values = {
        "title": F.when(undone, F.col("old_title")).otherwise(F.col("title")),
        "raw_content": F.when(undone, F.lit("")).otherwise(F.col("raw_content")),
        "scrape_status": F.when(failed, missed).when(undone, PENDING).otherwise(SUCCESS),
        "scraped_at": F.when(F.col("outcome") == SUCCESS, now).otherwise(F.col("scraped_at")),
        "updated_at": F.when(untouched, F.col("updated_at")).otherwise(now),
    }
    return rows.select(
        *[values.get(c, F.col(c)).alias(c) for c in BOOKMARK_COLUMNS], "embedding", "embedded_text_hash", "outcome"
    )


def backfill_rows(
    rows: DataFrame,
    batch_time: str | Column,
    summary_model: str | models.Model = "lead",
    embedder: str | models.Model | None = "hash",
    prompt: str | None = None,
    limits: Limits | None = None,
    book: AnswerBook | None = None,
) -> DataFrame:
    """New summary and keywords for rows with page text; without a summary the row stays untouched.

    ``limits`` and ``book`` as in ``enrich_rows``.
    """
    limits = limits or Limits()
    rows = rows.select(*BOOKMARK_COLUMNS)
    asked = summarize(book.numbered(rows) if book else rows, F.lit(True), summary_model, prompt, limits.prompt_bytes, book)
    good = F.col("answer").isNotNull() & (F.col("answer.summary") != "")
    done = asked.withColumns(
        {
            "outcome": F.when(good, SUCCESS).otherwise(MODEL_FAILED),
            "summary": F.when(good, F.col("answer.summary")).otherwise(F.col("summary")),
            "keywords": F.when(good, F.col("answer.keywords")).otherwise(F.col("keywords")),
            "updated_at": F.when(good, timestamp(batch_time)).otherwise(F.col("updated_at")),
        }
    )
    done = embed(done, F.col("outcome") == SUCCESS, embedder, limits.embed_bytes, book)
    return done.select(*BOOKMARK_COLUMNS, "embedding", "embedded_text_hash", "outcome")


OUTCOMES = (SUCCESS, FETCH_FAILED, MODEL_FAILED)


def tally(done: DataFrame) -> DataFrame:
    """Rows per outcome."""
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


# --- jobs over a table store ------------------------------------------------------------------


def save_enriched(store: TableStore, done: DataFrame, batch_id: str, beside: dict[str, DataFrame] | None = None, touched_too: dict[str, list[int]] | None = None) -> int:
    """Merge staged enrichment rows into the bookmark and vector tables in one commit.

    Only the buckets holding one of the rows are rewritten, and merged while they are: no stored text is shuffled for
    a join before. ``done`` holds whole rows of the stored table. ``beside`` holds further tables that change in
    the same commit, ``touched_too`` their buckets.
    """
    buckets = store.touched("bookmarks", done)
    rows = done.select(*BOOKMARK_COLUMNS)
    bookmarks = store.read("bookmarks", buckets).withColumn(NEWER, F.lit(False)).unionByName(rows.withColumn(NEWER, F.lit(True)))
    changes, touched = {"bookmarks": bookmarks, **(beside or {})}, {"bookmarks": buckets, **(touched_too or {})}
    made = done.filter(F.col("embedding").isNotNull()).select("id", "embedding", "embedded_text_hash")
    vector_buckets = store.touched("vectors", made)
    if vector_buckets:
        changes["vectors"] = catalog.put_vectors(store.read("vectors", vector_buckets), made)
        touched["vectors"] = vector_buckets
    if index_plan.is_current(store):
        index_changes, index_touched = index_plan.changes_for(store, done.select("id"), rows)
        changes |= index_changes
        touched |= index_touched
    index_plan.with_codes(changes, touched)
    return store.commit(batch_id, changes, touched)


def _logged(store: TableStore, done: DataFrame, run: str, batch_time: str | Column) -> tuple[DataFrame, list[int]]:
    """The ledger's buckets after a run, and which they are: one row per run and bookmark."""
    buckets = store.touched("enrich_log", done)
    log = store.read("enrich_log", buckets)
    before = log.join(done.select("id"), "id", "left_semi").groupBy("id").agg(F.max("attempt").alias("_before"))
    rows = done.join(before, "id", "left").select(
        F.lit(run).alias("run"), "id", (F.coalesce("_before", F.lit(0)) + 1).cast("int").alias("attempt"), "outcome",
        F.sha2(F.concat_ws("\n", "url", "raw_content"), 256).alias("input_hash"), timestamp(batch_time).alias("at"),
    )
    return log.unionByName(rows), buckets


def _run(
    store: TableStore, rows: DataFrame, batch_id: str, run: str, batch_time: str | Column, book: AnswerBook | None = None, beside: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Rows per outcome, counted by the job that stages them; rows, ledger and answers are one commit."""
    seen = Observation()
    counters = [F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES]
    done = stage(rows.observe(seen, *counters), "enriched")
    counts = [(name, n) for name, n in observed(seen, OUTCOMES).items() if n]
    changes, touched = dict(beside or {}), {}
    if counts:
        changes["enrich_log"], touched["enrich_log"] = _logged(store, done, run, batch_time)
        if book is not None:
            fresh = book.additions()
            touched["answers"] = store.touched("answers", fresh)
            changes["answers"] = store.read("answers", touched["answers"]).unionByName(fresh)
        save_enriched(store, done, batch_id, changes, touched)
    elif changes:
        store.commit(batch_id, changes)
    return store.spark.createDataFrame(counts, "outcome string, n bigint")


def due(store: TableStore, run: str, batch_time: str, parts: int = 1) -> DataFrame:
    """``enrich_due`` with a run of so many parts to be done."""
    values = (F.lit(run), F.lit(None).cast("string"), F.lit(parts), F.lit("due"), F.lit(None).cast("string"), timestamp(batch_time))
    names = [f.name for f in store.tables["enrich_due"].schema.fields]
    rows = store.spark.range(1).select(*[v.alias(n) for v, n in zip(values, names)])
    return catalog.replace_by_key(store.read("enrich_due"), rows, "run")


def is_due(store: TableStore, run: str) -> bool:
    return not store.read("enrich_due").filter(F.col("run") == run).isEmpty()


def enrich(
    store: TableStore,
    batch_time: str,
    batch_id: str,
    limit: int | None = None,
    rows_per_commit: int | None = None,
    most_commits: int | None = None,
    keep_answers: bool = False,
    **models_and_pages,
) -> DataFrame:
    """Work through the pending queue and return the tally of the run.

    With ``rows_per_commit`` the queue is cut into parts that lie in few buckets, each committed on its own; the
    number of parts is noted first, so a run that broke off, or that stopped after ``most_commits`` parts, is taken up by
    the next call with the same id where it stopped. ``keep_answers`` asks models only for texts that no
    earlier run had answered. The ledger ``enrich_log`` holds every attempt with its outcome.
    """
    noted = store.read("enrich_due").filter(F.col("run") == batch_id).first()
    parts = noted.attempt if noted else 1
    if rows_per_commit and parts == 1 and not store.has_batch(batch_id):
        waiting = listing.pending_queue(store.read("bookmarks"), limit).count()
        parts = max(1, -(-waiting // rows_per_commit))
        if parts > 1:
            store.commit(f"{batch_id}:parts", {"enrich_due": due(store, batch_id, batch_time, parts)})
    commits = 0
    for part in range(parts):
        last = part == parts - 1
        part_id = batch_id if last else f"{batch_id}:{part}"
        if store.has_batch(part_id):
            continue
        if most_commits is not None and commits == most_commits:
            break
        queue = listing.pending_queue(store.read("bookmarks"), limit)
        queue = queue.filter(store.slice_of("bookmarks", parts) == part) if parts > 1 else queue
        book = AnswerBook(store.read("answers")) if keep_answers else None
        done_with = {"enrich_due": store.read("enrich_due").filter(F.col("run") != batch_id)} if last and (noted or parts > 1) else None
        _run(store, enrich_rows(queue, batch_time, book=book, **models_and_pages), part_id, batch_id, batch_time, book, done_with)
        commits += 1
    return tally(store.read("enrich_log").filter(F.col("run") == batch_id))


def backfill(store: TableStore, batch_time: str, batch_id: str, limit: int | None = None, **models_only) -> DataFrame:
    """Summaries for rows that have page text but none; ``limit`` takes the latest only."""
    rows = listing.needs_summary(store.read("bookmarks"), limit)
    return _run(store, backfill_rows(rows, batch_time, **models_only), batch_id, batch_id, batch_time)


def reset(rows: DataFrame, batch_time: str | Column) -> DataFrame:
    """Rows as ``reset_for_reprocess`` leaves them, each decided by itself; rows without an id stay as they are."""
    return catalog.clear_where(rows, F.col("id").isNotNull(), catalog.reset_times(batch_time))


def _column(store: TableStore, values: Iterable[str] | DataFrame, name: str) -> DataFrame:
    """A few given values, or a table of any size with the column ``name``."""
    return values.select(name) if isinstance(values, DataFrame) else store.spark.createDataFrame([(v,) for v in values], f"{name} string")


def reprocess(store: TableStore, keys: Iterable[str] | DataFrame, batch_time: str, batch_id: str, **models_and_pages) -> DataFrame:
    """Fetch and summarize the bookmarks with these ids or urls (or those in the column ``key``) again.

    Keys without a bookmark are reported with the outcome ``not_found``.
    """
    wanted = _column(store, keys, "key")
    found = stage(reset(listing.lookup(store.read("bookmarks"), wanted), batch_time), "reset")
    rows = found.filter(F.col("id").isNotNull()).drop("key").dropDuplicates(["id"])
    again = enrich_rows(rows, batch_time, mode=REPROCESS, **models_and_pages)
    done = _run(store, again, batch_id, batch_id, batch_time)
    missing = found.filter(F.col("id").isNull()).agg(F.lit("not_found").alias("outcome"), F.count("*").alias("n"))
    return done.unionByName(missing.filter("n > 0"))


def add_manual(store: TableStore, urls: Iterable[str] | DataFrame, batch_time: str, batch_id: str, **models_and_pages) -> DataFrame:
    """Store new urls (or those in the column ``url``) as manual bookmarks and enrich them; returns the urls already stored."""
    wanted = _column(store, urls, "url")
    buckets = store.touched("bookmarks", wanted)
    stored = store.read("bookmarks", buckets)
    rejected = stage(catalog.already_stored(stored, wanted), "rejected")
    rows = catalog.manual_rows(stored, wanted, batch_time)
    done = stage(enrich_rows(rows, batch_time, mode=MANUAL, **models_and_pages), "manual")
    bookmarks = stored.unionByName(done.select(*stored.columns))
    changes, touched = {"bookmarks": bookmarks}, {"bookmarks": buckets}
    made = done.filter(F.col("embedding").isNotNull()).select("id", "embedding", "embedded_text_hash")
    vector_buckets = store.touched("vectors", made)
    if vector_buckets:
        changes["vectors"] = catalog.put_vectors(store.read("vectors", vector_buckets), made)
        touched["vectors"] = vector_buckets
    if index_plan.is_current(store):
        index_changes, index_touched = index_plan.changes_for(store, done.select("id"), bookmarks)
        changes |= index_changes
        touched |= index_touched
    index_plan.with_codes(changes, touched)
    store.commit(batch_id, changes, touched)
    return rejected
