"""Registered text-function queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, render, text, times
from ..functions.models import apply_model, hash_embedding
from ..plans import enrich
from ..plans.search import search
from ..sources.sinks import json_lines
from ..sources.vector_codec import decode_vector, encode_vector
from .search import _fused_sql, _text_ctes
from .views import (
    BOOKMARKS_SQL,
    bookmarks,
    documents,
    sql_id,
    sql_title,
    sql_token_list,
    sql_tokens,
    sql_trim,
    table,
)

RESULT_QUERY = "erons"
TEMPLATE = "What is this about?\n%s\nAnswer:"


def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.stable_id(F.col("url")).alias("id"))


def title_from_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of documents, of marked and of blank first lines, and of whole page sources."""
    docs = documents(spark, sf_dir)
    fallback = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    body = (
        F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("  TiTLE: "), F.col("text")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Title:  \n"), F.col("text")))
        .when(F.col("doc_id") % 4 == 3, F.concat(F.lit("\n"), F.col("text")))
        .otherwise(F.col("text"))
    )
    rows = docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), text.title_from_content(body, fallback).alias("title"))
    pages = table(spark, sf_dir, "pages")
    page = text.title_from_content(F.col("html"), F.col("url"))
    return rows.union(pages.select(F.lit("page"), "page_id", page))


def url_only_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls bare, padded and followed by a word, and document titles."""
    url = F.col("url")
    titles = F.array(url, F.concat(F.lit(" \t"), url, F.lit("\u00a0\n")), F.concat(url, F.lit(" x")), F.upper(url), F.lit(" "))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.posexplode(titles).alias("form", "title"))
    docs = bookmarks(spark, sf_dir).select(F.length("url").cast("bigint").alias("key"), F.lit(9).alias("form"), "title")
    return pages.union(docs).select("key", "form", "title", text.is_url_only_title(F.col("title")).alias("url_only"))


def title_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New titles under the three refresh rules."""
    rows = bookmarks(spark, sf_dir)
    stale = rows.withColumn("title", F.when(F.col("keywords") == "en", F.col("url")).otherwise(F.col("title")))
    refreshed = [enrich.refreshed_title(m, F.col("raw_content")).alias(m) for m in (enrich.QUEUE, enrich.REPROCESS, enrich.MANUAL)]
    return stale.select("id", *refreshed)


def byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to the embedding, model, scrape and display sizes."""
    docs = documents(spark, sf_dir)
    cut = {n: text.byte_cap(F.col("text"), n) for n in (101, 1003, text.MODEL_BYTES, text.EMBED_BYTES, text.SCRAPE_BYTES)}
    return docs.select("doc_id", *[c.alias(f"cut_{n}") if n < 2000 else F.md5(c).alias(f"cut_{n}") for n, c in cut.items()])


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    c = F.col("text")
    return rows.select(
        "conv_id",
        "turn",
        text.snippet(c, 100).alias("post_title"),
        render.cli_summary(c).alias("cli"),
        render.delete_prompt_title(c).alias("prompt"),
        text.snippet(c, 500).alias("preview"),
    )


def sanitize_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.sanitize_line(F.col("text")).alias("line"))


def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bookmarks(spark, sf_dir)
    return rows.select(
        "id",
        render.display_title(F.col("source"), F.col("title")).alias("shown_title"),
        render.display_description(F.col("summary"), F.col("url")).alias("description"),
        render.source_label(F.col("notes")).alias("unknown_label"),
    )


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON form of every bookmark without its long texts; blank texts and missing times are left out."""
    rows = bookmarks(spark, sf_dir).drop("raw_content", "created_at", "updated_at", "scraped_at", "title")
    return json_lines(rows.withColumn("summary", F.when(F.col("summary") == "", "").otherwise(F.md5("summary"))))


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two text forms of one search result."""
    found = search(bookmarks(spark, sf_dir), RESULT_QUERY)
    plain = found.select("rank", render.result_tsv().alias("tsv"))
    return plain.join(render.result_text(found).withColumnRenamed("n", "rank"), "rank")


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    return rows.select(
        "doc_id",
        F.md5(prompts.render_prompt(F.col("text"), None, prompts.PROMPT_BYTES)).alias("default_prompt"),
        F.md5(prompts.render_prompt(F.col("text"), TEMPLATE, prompts.PROMPT_BYTES)).alias("own_prompt"),
    )


def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses made of whole conversation turns, with repeated, blank and misspelt labels."""
    rows = table(spark, sf_dir, "conversations")
    flat = F.regexp_replace("text", r"\n", " ")
    response = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("ok\n  SUMMARY:  "), flat, F.lit(" \nmore\nKEYWORDS: a, "), "role"))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("SUMMARY: first\nSUMMARY: "), flat, F.lit("\nKEYWORDS:x\n\tKEYWORDS:")))
        .otherwise(F.concat(F.lit("summary: no\n"), F.col("text"), F.lit("\nKEYWORDS:\u00a0"), "role"))
    )
    parsed = prompts.parse_response(response)
    return rows.select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.summary", "p.keywords")


def text_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = text.text_to_embed(F.col("title"), F.col("summary"), F.col("keywords"))
    return bookmarks(spark, sf_dir).select("id", F.octet_length(joined).alias("bytes"), F.md5(joined).alias("digest"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token text and token count of every document and conversation turn."""
    docs = documents(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"), "text")
    rows = docs.union(turns).withColumn("tokens", text.token_text(F.col("text")))
    return rows.select("kind", "key", F.md5("tokens").alias("tokens"), text.token_count(F.col("tokens")).alias("n"))


def join_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags joined by commas: words of the document, its language, a missing tag, no list at all."""
    from ..sources.feeds import join_tags as joined

    tags = F.array("lang", F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.lit("x"))
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", joined(F.when(F.col("doc_id") % 5 > 0, tags)).alias("keywords"))


def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in the feed formats and read back; every fifth one is malformed."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    broken = F.col("event_id") % 5 == 0
    x = F.when(broken, F.date_format("t", "yyyy-MM-dd")).otherwise(F.date_format("t", "EEE MMM dd HH:mm:ss Z yyyy"))
    local = F.date_format(F.col("t") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rfc = F.when(broken, F.lit("yesterday")).otherwise(F.concat(local, F.lit("+02:00")))
    return rows.select(
        "event_id",
        F.unix_micros(times.parse_x_time(x)).alias("x_us"),
        F.unix_micros(times.parse_rfc3339(rfc)).alias("rfc_us"),
        F.unix_micros(times.to_second(times.parse_rfc3339(rfc))).alias("second_us"),
        times.format_rfc3339(F.col("t")).alias("mark"),
    )


def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through their stored byte form and back, and a damaged byte form."""
    stored = table(spark, sf_dir, "embeddings").withColumn("blob", encode_vector("embedding"))
    back = stored.withColumn("v", decode_vector("blob"))
    broken = decode_vector(F.substring(F.col("blob"), 1, 7))
    return back.select(
        "vec_id",
        F.octet_length("blob").alias("bytes"),
        F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double")).alias("total"),
        (F.col("v") == F.col("embedding")).alias("same"),
        broken.isNull().alias("damaged_is_null"),
    )


def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in embedding of every document, one row per non-zero element."""
    rows = documents(spark, sf_dir).withColumn("v", apply_model(hash_embedding, F.col("text"), "array<float>"))
    cells = rows.select("doc_id", F.posexplode("v").alias("pos", "value"))
    return cells.filter("value <> 0").select("doc_id", "pos", F.col("value").cast("double").alias("value"))


# --- SQL --------------------------------------------------------------------------------------


def sql_cap(c: str, n: int) -> str:
    b = f"encode({c})"
    tries = ", ".join(f"try(decode({b}[1:{n - i}]))" for i in range(4))
    return f"(CASE WHEN strlen({c}) <= {n} THEN {c} ELSE coalesce({tries}) END)"


def sql_snippet(c: str, limit: int, keep: int | None = None) -> str:
    return f"(CASE WHEN strlen({c}) > {limit} THEN {sql_cap(c, limit if keep is None else keep)} || '...' ELSE {c} END)"


def sql_sanitize(c: str) -> str:
    return sql_trim(f"regexp_replace(regexp_replace({c}, '[\\n\\r]', ' ', 'g'), ' {{2,}}', ' ', 'g')")


def sql_label(c: str) -> str:
    return f"(CASE {c} WHEN 'x' THEN '[X]' WHEN 'raindrop' THEN '[R]' WHEN 'github' THEN '[G]' WHEN 'manual' THEN '[M]' ELSE '[?]' END)"


def sql_url_only(c: str) -> str:
    t = sql_trim(c)
    return f"({t} = '' OR regexp_full_match({t}, 'https?://[^\\s\\x0B\\x85\\p{{Z}}]*'))"


def sql_last_line(response: str, label: str) -> str:
    lines = f"list_transform(string_split({response}, chr(10)), lambda l: {sql_trim('l')})"
    hits = f"list_filter({lines}, lambda l: starts_with(l, '{label}'))"
    return f"coalesce({sql_trim(f'substr({hits}[-1], {len(label) + 1})')}, '')"


_HEAD, _TAIL = prompts.DEFAULT_PROMPT.split("%s")
_OWN_HEAD, _OWN_TAIL = TEMPLATE.split("%s")
_NBSP = "chr(160)"
_TITLE_BODY = """CASE doc_id % 4 WHEN 1 THEN '  TiTLE: ' || text WHEN 2 THEN 'Title:  ' || chr(10) || text
  WHEN 3 THEN chr(10) || text ELSE text END"""
_STALE_BARE = "(title = '' OR title = url)"

QUERIES = {
    "stable_id": stable_id,
    "title_from_content": title_from_content,
    "url_only_title": url_only_title,
    "title_refresh": title_refresh,
    "byte_cap": byte_cap,
    "snippet": snippets,
    "sanitize_line": sanitize_line,
    "display_rows": display_rows,
    "result_json": result_json,
    "result_lines": result_lines,
    "prompt_render": prompt_render,
    "response_parse": response_parse,
    "text_to_embed": text_to_embed,
    "tokens": tokens,
    "join_tags": join_tags,
    "parse_times": parse_times,
    "vector_codec": vector_codec,
    "embed_hash": embed_hash,
}

ORACLE = {
    "stable_id": f"SELECT page_id, {sql_id('url')} AS id FROM pages",
    "title_from_content": f"""WITH bodies AS (SELECT doc_id, {_TITLE_BODY} AS body, 'doc ' || doc_id AS fallback FROM documents)
SELECT 'document' AS kind, doc_id AS key, {sql_title('body', 'fallback')} AS title FROM bodies
UNION ALL SELECT 'page', page_id, {sql_title('html', 'url')} FROM pages""",
    "url_only_title": f"""WITH {BOOKMARKS_SQL},
titles AS (
  SELECT page_id AS key, unnest([0, 1, 2, 3, 4]) AS form,
         unnest([url, ' ' || chr(9) || url || {_NBSP} || chr(10), url || ' x', upper(url), ' ']) AS title FROM pages
  UNION ALL SELECT length(url), 9, title FROM bookmarks)
SELECT key, form, title, {sql_url_only('title')} AS url_only FROM titles""",
    "title_refresh": f"""WITH {BOOKMARKS_SQL},
stale AS (SELECT b.* REPLACE (CASE WHEN keywords = 'en' THEN url ELSE title END AS title) FROM bookmarks b),
fresh AS (SELECT *, {sql_title('raw_content', 'title')} AS new_title FROM stale)
SELECT id,
  CASE WHEN source = 'manual' AND {_STALE_BARE} OR source = 'x' AND {sql_url_only('title')} THEN new_title ELSE title END AS queue,
  CASE WHEN source <> 'x' OR {sql_url_only('title')} THEN new_title ELSE title END AS reprocess,
  new_title AS manual FROM fresh""",
    "byte_cap": f"""SELECT doc_id, {sql_cap('text', 101)} AS cut_101, {sql_cap('text', 1003)} AS cut_1003,
  md5({sql_cap('text', 10000)}) AS cut_10000, md5({sql_cap('text', 30000)}) AS cut_30000,
  md5({sql_cap('text', 50000)}) AS cut_50000 FROM documents""",
    "snippet": f"""SELECT conv_id, turn, {sql_snippet('text', 100)} AS post_title, {sql_snippet('text', 100, 97)} AS cli,
  {sql_snippet('text', 50)} AS prompt, {sql_snippet('text', 500)} AS preview FROM conversations""",
    "sanitize_line": f"SELECT conv_id, turn, {sql_sanitize('text')} AS line FROM conversations",
    "display_rows": f"""WITH {BOOKMARKS_SQL}
SELECT id, {sql_label('source')} || ' ' || {sql_sanitize('title')} AS shown_title,
  CASE WHEN summary <> '' THEN {sql_snippet('s', 80)} ELSE url END AS description, {sql_label('notes')} AS unknown_label
FROM (SELECT *, {sql_sanitize('summary')} AS s FROM bookmarks)""",
    "result_json": f"""WITH {BOOKMARKS_SQL}
SELECT '{{"id":"' || id || '","source":"' || source || '","url":"' || url || '"' ||
  CASE WHEN summary = '' THEN '' ELSE ',"summary":"' || md5(summary) || '"' END ||
  ',"keywords":"' || keywords || '","notes":"' || notes || '","scrape_status":"' || scrape_status ||
  '","hidden":' || CASE WHEN hidden THEN 'true' ELSE 'false' END || '}}' AS value FROM bookmarks""",
    "result_lines": f"""WITH {BOOKMARKS_SQL}, {_text_ctes(RESULT_QUERY)}, {_fused_sql(['text_hits'], 20)}
SELECT rank, source || chr(9) || title || chr(9) || url AS tsv,
  rank || '. ' || {sql_label('source')} || ' ' || title || chr(10) || '   ' || url ||
  CASE WHEN summary <> '' THEN chr(10) || '   ' || {sql_snippet('summary', 100, 97)} ELSE '' END AS line
FROM fused JOIN bookmarks USING (id)""",
    "prompt_render": f"""SELECT doc_id, md5('{_HEAD}' || {sql_cap('text', 10000)} || '{_TAIL}') AS default_prompt,
  md5('{_OWN_HEAD}' || {sql_cap('text', 10000)} || '{_OWN_TAIL}') AS own_prompt FROM documents""",
    "response_parse": f"""WITH flat AS (SELECT *, replace(text, chr(10), ' ') AS f FROM conversations),
responses AS (SELECT conv_id, turn, CASE turn % 3
  WHEN 0 THEN 'ok' || chr(10) || '  SUMMARY:  ' || f || ' ' || chr(10) || 'more' || chr(10) || 'KEYWORDS: a, ' || role
  WHEN 1 THEN 'SUMMARY: first' || chr(10) || 'SUMMARY: ' || f || chr(10) || 'KEYWORDS:x' || chr(10) || chr(9) || 'KEYWORDS:'
  ELSE 'summary: no' || chr(10) || text || chr(10) || 'KEYWORDS:' || {_NBSP} || role END AS r FROM flat)
SELECT conv_id, turn, {sql_last_line('r', 'SUMMARY:')} AS summary, {sql_last_line('r', 'KEYWORDS:')} AS keywords FROM responses""",
    "text_to_embed": f"""WITH {BOOKMARKS_SQL}, joined AS (SELECT id, title || ' ' || summary || ' ' || keywords AS t FROM bookmarks)
SELECT id, strlen(t)::INTEGER AS bytes, md5(t) AS digest FROM joined""",
    "tokens": f"""WITH rows AS (
  SELECT 'document' AS kind, doc_id AS key, text FROM documents
  UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)
SELECT kind, key, md5({sql_tokens('text')}) AS tokens, len({sql_token_list('text')})::INTEGER AS n FROM rows""",
    "join_tags": """SELECT doc_id, CASE WHEN doc_id % 5 > 0
  THEN lang || ',' || CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END || ',x' ELSE '' END AS keywords FROM documents""",
    "parse_times": """SELECT event_id,
  CASE WHEN event_id % 5 > 0 THEN epoch_us(date_trunc('second', ts)) END AS x_us,
  CASE WHEN event_id % 5 > 0 THEN epoch_us(ts) END AS rfc_us,
  CASE WHEN event_id % 5 > 0 THEN epoch_us(date_trunc('second', ts)) END AS second_us,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS mark FROM events""",
    "vector_codec": """SELECT vec_id, (4 * len(embedding))::INTEGER AS bytes,
  list_reduce(list_prepend(0.0::DOUBLE, embedding::DOUBLE[]), lambda a, x: a + x) AS total,
  true AS same, true AS damaged_is_null FROM embeddings""",
    "embed_hash": f"""WITH t AS (SELECT doc_id, unnest({sql_token_list('text')}) AS token FROM documents),
c AS (SELECT doc_id, md5(token) AS h, count(*) AS n FROM t GROUP BY doc_id, token),
cells AS (SELECT doc_id, (('0x' || left(h, 8))::BIGINT % 64)::INTEGER AS pos,
  sum(CASE WHEN ('0x' || substr(h, 15, 2))::BIGINT % 2 = 0 THEN n ELSE -n END)::DOUBLE AS value FROM c GROUP BY ALL)
SELECT doc_id, pos, value FROM cells WHERE value <> 0""",
}
