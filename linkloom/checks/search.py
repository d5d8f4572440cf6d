"""Registered search queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, query_tokens, stable_id, TOKEN_GAP
from ..operators import fulltext, vectors as vector_ops
from ..operators.fusion import reciprocal_rank_fusion, top_ranked
from ..operators.listing import hidden_ids
from ..operators.skew import near_keys
from ..plans import index as index_plan
from ..plans import search as search_plan
from ..schema import INDEXED_FIELDS
from ..session import stage
from .views import (
    BOOKMARKS_SQL,
    VECTORS_SQL,
    bookmarks,
    documents,
    doc_url,
    sql_id,
    sql_token_list,
    table,
    vectors,
)

QUERY = "thatth reti"
FIELD_QUERY = "the src1"
FIELD_WEIGHTS = {"title": 3.0, "summary": 1.0, "notes": 2.0}
HYBRID_QUERY = "erons lyti"


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", F.round("score", 6))


def search_bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fulltext.search_scan(bookmarks(spark, sf_dir), QUERY))


def search_bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bookmarks(spark, sf_dir)
    return _shown(fulltext.search_scan(rows, FIELD_QUERY, fields=list(FIELD_WEIGHTS), weights=FIELD_WEIGHTS))


def search_bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bookmarks(spark, sf_dir)
    stats = fulltext.corpus_stats(fulltext.doc_lengths(rows))
    return _shown(fulltext.search_index(index_plan.index_rows(rows), stats, hidden_ids(rows), QUERY))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark passage: the three longest words of its whole text."""
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(fold("text"), TOKEN_GAP, " ")), " "))
    by_length = F.array_sort(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))
    query = F.array_join(F.transform(F.slice(by_length, 1, 3), lambda s: s["w"]), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), query.alias("query"))


def search_bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bookmarks(spark, sf_dir)
    stats = fulltext.corpus_stats(fulltext.doc_lengths(rows))
    queries = benchmark_queries(spark, sf_dir)
    index = stage(fulltext.postings(rows), "postings")
    return _shown(fulltext.search_batch(index, stats, hidden_ids(rows), queries))


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built index, summed up per term and field."""
    rows = index_plan.index_rows(bookmarks(spark, sf_dir))
    return rows.groupBy("lead", "term", "field").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index maintenance after an edit: labelled bookmarks lose their summary, toxic ones go away."""
    rows = bookmarks(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(stable_id(doc_url()).alias("id"), "toxic")
    marked = rows.join(labels, "id", "left")
    after = marked.filter(F.coalesce("toxic", F.lit(0)) == 0).select(
        *[F.when(F.col("toxic").isNotNull(), "").otherwise(F.col(c)).alias(c) if c == "summary" else c for c in rows.columns]
    )
    base = index_plan.index_rows(rows)
    recent = index_plan.recent_postings(base.limit(0), labels, after)
    updated = index_plan.live_postings(base, recent, labels)
    return updated.groupBy("term", "field").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(vector_ops.vector_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir)))


def vector_topk_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = hidden_ids(bookmarks(spark, sf_dir))
    return _shown(vector_ops.vector_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir), hidden_ids=hidden))


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the first vector carrying it."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy(F.col("label").cast("string").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(vector_ops.vector_topk_batch(vectors(spark, sf_dir), label_vectors(spark, sf_dir)))


def cosine_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with the query vector, as a plain column expression."""
    q = F.array(*[F.lit(v).cast("float") for v in query_vector(spark, sf_dir)])
    score = vector_ops.cosine_similarity(F.col("embedding"), q)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fulltext.search_scan(bookmarks(spark, sf_dir), HYBRID_QUERY)
    near = vector_ops.vector_topk(vectors(spark, sf_dir), query_vector(spark, sf_dir))
    return _shown(top_ranked(reciprocal_rank_fusion([text, near]), 100))


def hybrid_search_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bookmarks(spark, sf_dir)
    found = search_plan.search(rows, HYBRID_QUERY, vectors(spark, sf_dir), query_vector(spark, sf_dir))
    return _shown(found.select("rank", "score", "id", "source", "url", "title", "summary"))


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search without a query vector: the fused list is the text list."""
    found = search_plan.search(bookmarks(spark, sf_dir), QUERY, limit=50)
    return _shown(found.select("rank", "score", "id", "source", "url", "title"))


def search_many_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused search for every label: its name's first document words and its first vector."""
    rows = bookmarks(spark, sf_dir)
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # Which documents come first is found on ids alone, so that only their texts are moved.
    firsts = embedded.join(docs.select("doc_id"), "doc_id").groupBy(F.col("label").cast("string").alias("query_id")).agg(
        F.min_by("embedding", "doc_id").alias("embedding"), F.min("doc_id").alias("doc_id")
    )
    firsts = stage(firsts, "firsts")
    texts = docs.join(near_keys(firsts.select("doc_id").distinct())[0], "doc_id", "left_semi")
    firsts = firsts.join(texts.groupBy("doc_id").agg(F.first("text").alias("text")), "doc_id")
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(fold("text"), TOKEN_GAP, " ")), " "))
    by_length = F.array_sort(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))
    query = F.element_at(by_length, 1)["w"]
    queries = stage(firsts.select("query_id", query.alias("query"), "embedding"), "queries")
    stats = fulltext.corpus_stats(fulltext.doc_lengths(rows))
    index = stage(fulltext.postings(rows), "postings")
    found = search_plan.search_many(rows, index, stats, queries, vectors(spark, sf_dir))
    return _shown(found)


# --- SQL --------------------------------------------------------------------------------------


def _counted_sql(query: str, fields=INDEXED_FIELDS, weights=None) -> str:
    terms = query_tokens(query)
    weights = weights or {}
    lists = ", ".join(f"{sql_token_list(f)} AS l_{f}" for f in INDEXED_FIELDS)
    length = " + ".join(f"len(l_{f})" for f in INDEXED_FIELDS)

    def hits(term: str, weighted: bool) -> str:
        return " + ".join(
            f"{weights.get(f, 1.0) if weighted else 1} * len(list_filter(l_{f}, lambda t: starts_with(t, '{term}')))"
            for f in fields
        )

    cols = ", ".join(f"({hits(t, False)}) AS h{i}, ({hits(t, True)})::DOUBLE AS f{i}" for i, t in enumerate(terms))
    return f"""token_lists AS (SELECT id, hidden, {lists} FROM bookmarks),
counted AS (SELECT id, hidden, {length} AS length, {cols} FROM token_lists),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean_length,
           {', '.join(f'count(*) FILTER (h{i} > 0)::DOUBLE AS df{i}' for i in range(len(terms)))} FROM counted)"""


def _idf_sql(df: str) -> str:
    raw = f"ln((n - {df} + 0.5) / ({df} + 0.5))"
    return f"(CASE WHEN {raw} > 0 THEN {raw} ELSE 1e-6 END)"


def _text_ctes(query: str, name: str = "text_hits", limit: int = 50, **options) -> str:
    n = len(query_tokens(query))
    score = " + ".join(
        f"{_idf_sql(f'df{i}')} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / mean_length))" for i in range(n)
    )
    match = " AND ".join(f"h{i} > 0" for i in range(n))
    return f"""{_counted_sql(query, **options)},
{name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank
  FROM (SELECT id, {score} AS score FROM counted, corpus WHERE NOT hidden AND {match})
  ORDER BY score DESC, id LIMIT {limit})"""


_COSINE = """CASE WHEN len(a) <> len(b) OR list_dot_product(a, a) = 0 OR list_dot_product(b, b) = 0 THEN 0
  ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END"""

_QUERY_VECTOR = "q AS (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 0)"


def _vector_ctes(where: str = "true", name: str = "vector_hits") -> str:
    return f"""{_QUERY_VECTOR},
scored AS (SELECT id, {_COSINE} AS score FROM (SELECT id, embedding::DOUBLE[] AS a FROM vectors WHERE {where}), q),
{name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank
  FROM scored ORDER BY score DESC, id LIMIT 50)"""


def _fused_sql(legs: list[str], limit: int) -> str:
    union = " UNION ALL ".join(f"SELECT id, rank FROM {leg}" for leg in legs)
    return f"""fused AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank
  FROM (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ({union}) GROUP BY id)
  ORDER BY score DESC, id LIMIT {limit})"""


_RANKED = "SELECT id, round(score, 6) AS score, rank FROM"

_POSTINGS_SQL = f"""token_rows AS (
  {' UNION ALL '.join(f"SELECT id, '{f}' AS field, unnest({sql_token_list(f)}) AS term FROM bookmarks" for f in INDEXED_FIELDS)}),
postings AS (SELECT term, id, field, count(*) AS tf FROM token_rows GROUP BY ALL),
lengths AS (SELECT b.id, count(t.term) AS length FROM bookmarks b LEFT JOIN token_rows t USING (id) GROUP BY b.id),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean_length FROM lengths)"""


def _longest_words_sql(text: str, n: int) -> str:
    words = f"list_distinct({sql_token_list(text)})"
    by_length = f"list_sort(list_transform({words}, lambda w: {{'n': -length(w), 'w': w}}))"
    return f"list_transform({by_length}[1:{n}], lambda s: s.w)"


def _batch_ctes(queries_cte: str) -> str:
    """Ranked text hits per query from ``queries(query_id, terms)``."""
    return f"""{queries_cte},
query_terms AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS qterm, generate_subscripts(terms, 1) AS pos FROM queries),
wanted AS (SELECT DISTINCT qterm FROM query_terms),
vocabulary AS (SELECT DISTINCT term FROM postings),
mapping AS (SELECT qterm, term FROM wanted, vocabulary WHERE starts_with(term, qterm)),
hits AS (SELECT qterm, id, sum(tf)::DOUBLE AS freq FROM mapping JOIN postings USING (term) GROUP BY ALL),
dfs AS (SELECT qterm, count(*)::DOUBLE AS df FROM hits GROUP BY ALL),
batch_scored AS (
  SELECT query_id, id,
         sum({_idf_sql('df')} * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM query_terms JOIN hits USING (qterm) JOIN dfs USING (qterm) JOIN lengths USING (id), corpus
  GROUP BY query_id, id HAVING count(*) = any_value(n_terms)),
batch_hits AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
  FROM batch_scored JOIN (SELECT id FROM bookmarks WHERE NOT hidden) USING (id)
  QUALIFY rank <= 50)"""


_LABEL_VECTORS = """label_queries AS (
  SELECT label::VARCHAR AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS b FROM embeddings GROUP BY label)"""


def _vector_batch_ctes(where: str = "true") -> str:
    return f"""vector_scored AS (
  SELECT query_id, id, {_COSINE} AS score
  FROM (SELECT id, embedding::DOUBLE[] AS a FROM vectors WHERE {where}), label_queries),
vector_batch AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
  FROM vector_scored QUALIFY rank <= 50)"""


_VISIBLE_VECTOR = "id NOT IN (SELECT id FROM bookmarks WHERE hidden)"

_MANY_QUERIES = f"""firsts AS (
  SELECT label::VARCHAR AS query_id, arg_min(embedding, doc_id) AS embedding, arg_min(text, doc_id) AS text
  FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY label),
label_queries AS (SELECT query_id, embedding::DOUBLE[] AS b FROM firsts),
queries AS (SELECT query_id, {_longest_words_sql('text', 1)} AS terms FROM firsts)"""

_UPDATED_SQL = f"""{BOOKMARKS_SQL},
labelled AS (SELECT {sql_id("'https://example.org/d/' || doc_id")} AS id, toxic FROM labels),
after AS (
  SELECT b.* REPLACE (CASE WHEN l.id IS NOT NULL THEN '' ELSE summary END AS summary)
  FROM bookmarks b LEFT JOIN labelled l USING (id) WHERE coalesce(toxic, 0) = 0),
token_rows AS (
  {' UNION ALL '.join(f"SELECT id, '{f}' AS field, unnest({sql_token_list(f)}) AS term FROM after" for f in INDEXED_FIELDS)}),
postings AS (SELECT term, id, field, count(*) AS tf FROM token_rows GROUP BY ALL)"""

QUERIES = {
    "search_bm25_prefix": search_bm25_prefix,
    "search_bm25_fields": search_bm25_fields,
    "search_bm25_index": search_bm25_index,
    "search_bm25_batch": search_bm25_batch,
    "index_terms": index_terms,
    "index_update": index_update,
    "vector_topk": vector_topk,
    "vector_topk_visible": vector_topk_visible,
    "vector_topk_batch": vector_topk_batch,
    "cosine_columns": cosine_columns,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_search_hydrated": hybrid_search_hydrated,
    "keyword_search": keyword_search,
    "search_many_hybrid": search_many_hybrid,
}

ORACLE = {
    "search_bm25_prefix": f"WITH {BOOKMARKS_SQL}, {_text_ctes(QUERY)} {_RANKED} text_hits",
    "search_bm25_fields": f"""WITH {BOOKMARKS_SQL},
{_text_ctes(FIELD_QUERY, fields=list(FIELD_WEIGHTS), weights=FIELD_WEIGHTS)} {_RANKED} text_hits""",
    "search_bm25_index": f"WITH {BOOKMARKS_SQL}, {_text_ctes(QUERY)} {_RANKED} text_hits",
    "search_bm25_batch": f"""WITH {BOOKMARKS_SQL}, {_POSTINGS_SQL},
{_batch_ctes(f"queries AS (SELECT item_id AS query_id, {_longest_words_sql('text', 3)} AS terms FROM benchmark)")}
SELECT query_id, id, round(score, 6) AS score, rank FROM batch_hits""",
    "index_terms": f"""WITH {BOOKMARKS_SQL}, {_POSTINGS_SQL}
SELECT CASE WHEN regexp_matches(term, '^[a-z0-9]') THEN left(term, 1) ELSE '_' END AS lead, term, field,
       count(*) AS df, sum(tf)::BIGINT AS occurrences FROM postings GROUP BY ALL""",
    "index_update": f"""WITH {_UPDATED_SQL}
SELECT term, field, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM postings GROUP BY ALL""",
    "vector_topk": f"WITH {VECTORS_SQL}, {_vector_ctes()} {_RANKED} vector_hits",
    "vector_topk_visible": f"WITH {BOOKMARKS_SQL}, {VECTORS_SQL}, {_vector_ctes(_VISIBLE_VECTOR)} {_RANKED} vector_hits",
    "vector_topk_batch": f"""WITH {VECTORS_SQL}, {_LABEL_VECTORS}, {_vector_batch_ctes()}
SELECT query_id, id, round(score, 6) AS score, rank FROM vector_batch""",
    "cosine_columns": f"""WITH {_QUERY_VECTOR}
SELECT vec_id, round({_COSINE}, 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings), q""",
    "hybrid_rrf": f"""WITH {BOOKMARKS_SQL}, {VECTORS_SQL}, {_text_ctes(HYBRID_QUERY)}, {_vector_ctes()},
{_fused_sql(['text_hits', 'vector_hits'], 100)} {_RANKED} fused""",
    "hybrid_search_hydrated": f"""WITH {BOOKMARKS_SQL}, {VECTORS_SQL}, {_text_ctes(HYBRID_QUERY)},
{_vector_ctes(_VISIBLE_VECTOR)}, {_fused_sql(['text_hits', 'vector_hits'], 20)}
SELECT rank, round(score, 6) AS score, id, source, url, title, summary FROM fused JOIN bookmarks USING (id)""",
    "keyword_search": f"""WITH {BOOKMARKS_SQL}, {_text_ctes(QUERY)}, {_fused_sql(['text_hits'], 50)}
SELECT rank, round(score, 6) AS score, id, source, url, title FROM fused JOIN bookmarks USING (id)""",
    "search_many_hybrid": f"""WITH {BOOKMARKS_SQL}, {VECTORS_SQL}, {_POSTINGS_SQL}, {_batch_ctes(_MANY_QUERIES)},
{_vector_batch_ctes(_VISIBLE_VECTOR)}
SELECT query_id, id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
FROM (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score
      FROM (SELECT query_id, id, rank FROM batch_hits UNION ALL SELECT query_id, id, rank FROM vector_batch)
      GROUP BY query_id, id)
QUALIFY rank <= 20""",
}
