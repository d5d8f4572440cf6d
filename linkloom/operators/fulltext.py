"""Prefix full-text search scored with BM25.

Every query term is a prefix; a row matches when each term starts at least one of its tokens, in
any of the searched fields. Document frequencies belong to the prefix, not to a word, so they are
taken per query from the rows that hold any such token. Corpus size and mean length count every
row, hidden ones included; hidden rows are dropped after matching.

One query can be answered by a scan (``search_scan``) or from an index (``search_index``); many
queries at once use the index form (``search_batch``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN_GAP, fold, prefix_count, query_tokens, token_count, token_text
from ..schema import INDEXED_FIELDS
from ..session import stage
from .fusion import top_ranked, top_ranked_by_query
from .skew import computed_once, sized_join

K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
CANDIDATES = 50


def idf(n_rows: Column, n_hits: Column) -> Column:
    raw = F.log((n_rows - n_hits + 0.5) / (n_hits + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def term_score(weight: Column, freq: Column, length: Column, mean_length: Column) -> Column:
    return weight * freq * F.lit(K1 + 1) / (freq + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean_length))


def _field_weights(fields: Sequence[str] | None, weights: dict[str, float] | None) -> dict[str, float]:
    chosen = list(fields) if fields else list(INDEXED_FIELDS)
    unknown = set(chosen) - set(INDEXED_FIELDS)
    if unknown:
        raise ValueError(f"not an indexed field: {sorted(unknown)}")
    return {f: float((weights or {}).get(f, 1.0)) for f in chosen}


def _tokenized(bookmarks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, the ``length`` of the row and the tokens of each field."""
    tokens = computed_once(bookmarks, keep, {f: token_text(F.col(f)) for f in INDEXED_FIELDS})
    length = reduce(Column.__add__, [token_count(F.col(f)) for f in INDEXED_FIELDS])
    return tokens.withColumn("length", length)


# --- one query over the bookmark table --------------------------------------------------------


def _term_counts(
    bookmarks: DataFrame, terms: list[str], per_field: dict[str, float], matching_only: bool = False
) -> DataFrame:
    """``id, length`` and for each term its plain (``hits``) and weighted (``freq``) token counts.

    ``matching_only`` leaves out hidden rows and most rows that cannot match, before they are
    tokenized.
    """
    rows = bookmarks.filter(~F.col("hidden")) if matching_only else bookmarks
    plain = all(w == 1.0 for w in per_field.values()) and len(per_field) == len(INDEXED_FIELDS)
    rows = computed_once(rows, ["id"] if plain else ["id", *INDEXED_FIELDS], {"text": F.concat_ws(" ", *per_field)})
    if matching_only:
        rows = rows.filter(_may_match(F.col("text"), terms))
    if plain:
        # No token spans two fields, so they can be tokenized as one text.
        tokens = computed_once(rows, ["id"], {"tokens": token_text(F.col("text"))})
        tokens = tokens.withColumn("length", token_count(F.col("tokens")))
        hits = [prefix_count(F.col("tokens"), t) for t in terms]
        freqs = hits
    else:
        tokens = _tokenized(rows, ["id"])
        hits = [reduce(Column.__add__, [prefix_count(F.col(f), t) for f in per_field]) for t in terms]
        freqs = [
            reduce(Column.__add__, [F.lit(w) * prefix_count(F.col(f), t) for f, w in per_field.items()]) for t in terms
        ]
    counts = {f"hits{i}": c for i, c in enumerate(hits)} | {f"freq{i}": c.cast("double") for i, c in enumerate(freqs)}
    return computed_once(tokens, ["id", "length"], counts)


def _may_match(text: Column, terms: list[str]) -> Column:
    """A cheap test no matching row fails: a plain ASCII row must contain every term as it stands."""
    low = F.lower(text)
    present = reduce(Column.__and__, [low.contains(t) for t in terms])
    return present | (F.octet_length(text) != F.char_length(text))


def search_scan(
    bookmarks: DataFrame,
    query: str,
    limit: int = CANDIDATES,
    fields: Sequence[str] | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """``(id, score, rank)`` of the best visible rows, straight from the bookmark table.

    Reads the five indexed text columns only and shuffles no rows: term counts are expressions
    of one row, the corpus statistics one aggregate row used as a scalar subquery.
    """
    terms = query_tokens(query)
    if not terms:
        return bookmarks.sparkSession.createDataFrame([], "id string, score double, rank int")
    per_field = _field_weights(fields, weights)
    counted = _term_counts(bookmarks, terms, per_field)
    corpus = counted.agg(
        F.struct(
            F.count("*").cast("double").alias("n"),
            F.avg("length").alias("mean_length"),
            *[F.count_if(F.col(f"hits{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(terms))],
        ).alias("corpus")
    )
    all_terms = reduce(Column.__and__, [F.col(f"hits{i}") > 0 for i in range(len(terms))])
    matched = _term_counts(bookmarks, terms, per_field, matching_only=True).filter(all_terms)
    matched = matched.withColumn("corpus", corpus.scalar())
    score = reduce(
        Column.__add__,
        [
            term_score(
                idf(F.col("corpus.n"), F.col(f"corpus.df{i}")), F.col(f"freq{i}"), F.col("length"), F.col("corpus.mean_length")
            )
            for i in range(len(terms))
        ],
    )
    return top_ranked(matched.select("id", score.alias("score")), limit)


# --- the index --------------------------------------------------------------------------------


def token_rows(bookmarks: DataFrame) -> DataFrame:
    """``id, length`` and the tokens of each field, one row per id and length.

    This is the only shuffle of the index: texts travel once, as short as they are, and the rows of an id that is
    there more than once are put together. All that is counted per bookmark is then counted within its row.
    """
    return put_together(_tokenized(bookmarks, ["id"]))


def token_texts(bookmarks: DataFrame) -> DataFrame:
    """``token_rows`` before the rows of an id are put together: ``id, length`` and tokens of every bookmark, without a shuffle."""
    return _tokenized(bookmarks, ["id"])


def put_together(tokens: DataFrame, place: Sequence[str] = ()) -> DataFrame:
    """One row per id and length of ``token_texts``; ``place`` names columns that follow from the id, by which rows already lie."""
    joined = {f: F.array_join(F.filter(F.collect_list(f), lambda t: t != ""), " ").alias(f) for f in INDEXED_FIELDS}
    return tokens.groupBy(*place, "id", "length").agg(*joined.values())


def postings_of(tokens: DataFrame) -> DataFrame:
    """``(term, id, field, tf, length)`` and what else ``token_rows`` carry, one row per term and field of a row.

    The words of a field are sorted in its row and counted as the lengths of runs, without a shuffle or a hash table.
    """
    keep = [c for c in tokens.columns if c not in INDEXED_FIELDS]
    more = [c for c in keep if c not in ("id", "length")]
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("tokens")) for f in INDEXED_FIELDS])
    rows = tokens.select(*keep, F.explode(per_field).alias("f")).filter(F.col("f.tokens") != "")
    rows = rows.select(*keep, F.col("f.field").alias("field"), F.col("f.tokens").alias("tokens"))
    rows = computed_once(rows, [*keep, "field"], {"words": F.sort_array(F.split("tokens", " "))})
    word = lambda i: F.element_at("words", i)
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: (i == 1) | (word(i) != word(F.greatest(i - 1, F.lit(1)))))
    rows = computed_once(rows, [*keep, "field", "words"], {"starts": starts})
    end = lambda n: F.coalesce(F.get("starts", n + 1), F.size("words") + 1)
    runs = F.transform("starts", lambda i, n: F.struct(word(i).alias("term"), (end(n) - i).cast("int").alias("tf")))
    return rows.select(*keep, "field", F.inline(runs)).select("term", "id", "field", "tf", "length", *more)


def postings(bookmarks: DataFrame) -> DataFrame:
    """``(term, id, field, tf, length)``, one row per term and field of a bookmark."""
    return postings_of(token_rows(bookmarks))


def doc_lengths(bookmarks: DataFrame) -> DataFrame:
    """``(id, length)`` of every bookmark, those without a single token included."""
    tokens = computed_once(bookmarks, ["id"], {"tokens": token_text(F.concat_ws(" ", *INDEXED_FIELDS))})
    return computed_once(tokens, ["id"], {"length": token_count(F.col("tokens"))})


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of bookmarks and mean length."""
    return lengths.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean_length"))


def lead(term: Column) -> Column:
    """Coarse index folder of a term: its first ASCII letter or digit, else ``_``."""
    first = F.left(term, F.lit(1))
    return F.when(first.between("0", "9") | first.between("a", "z"), first).otherwise("_")


def prefix_filter(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Posting rows that start with any of ``terms``; folder pruning plus a pushed prefix filter."""
    wanted = reduce(Column.__or__, [F.col("term").startswith(t) for t in terms])
    if "lead" in index.columns:
        wanted = wanted & F.col("lead").isin(sorted({t[0] if t[0].isascii() else "_" for t in terms}))
    return index.filter(wanted)


def search_index(
    index: DataFrame,
    stats: DataFrame,
    hidden_ids: DataFrame,
    query: str,
    limit: int = CANDIDATES,
    fields: Sequence[str] | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """``search_scan`` answered from postings: reads only the terms with a queried prefix.

    Matches are checked against the ids of hidden rows. Those are few or none, and a scan for
    them skips every row group without one, which a scan for the visible rows could not.
    """
    terms = query_tokens(query)
    if not terms:
        return index.sparkSession.createDataFrame([], "id string, score double, rank int")
    per_field = _field_weights(fields, weights)
    rows = prefix_filter(index, terms).filter(F.col("field").isin(list(per_field)))
    weight = reduce(lambda c, fw: F.when(F.col("field") == fw[0], F.lit(fw[1])).otherwise(c), per_field.items(), F.lit(1.0))
    sums = []
    for i, t in enumerate(terms):
        of_term = F.col("term").startswith(t)
        sums.append(F.sum(F.when(of_term, F.col("tf")).otherwise(0)).alias(f"hits{i}"))
        sums.append(F.sum(F.when(of_term, weight * F.col("tf")).otherwise(0.0)).alias(f"freq{i}"))
    counted = rows.groupBy("id").agg(F.max("length").alias("length"), *sums)
    frequencies = counted.agg(
        F.struct(*[F.count_if(F.col(f"hits{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(terms))]).alias("dfs")
    )
    all_terms = reduce(Column.__and__, [F.col(f"hits{i}") > 0 for i in range(len(terms))])
    corpus = stats.select(F.struct("n", "mean_length").alias("corpus"))
    matched = (
        counted.filter(all_terms)
        .join(hidden_ids.select("id"), "id", "left_anti")
        .withColumns({"corpus": corpus.scalar(), "dfs": frequencies.scalar()})
    )
    score = reduce(
        Column.__add__,
        [
            term_score(idf(F.col("corpus.n"), F.col(f"dfs.df{i}")), F.col(f"freq{i}"), F.col("length"), F.col("corpus.mean_length"))
            for i in range(len(terms))
        ],
    )
    return top_ranked(matched.select("id", score.alias("score")), limit)


# --- many queries -----------------------------------------------------------------------------


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, pos, qterm, n_terms)`` from ``(query_id, query)``; blank queries give no row."""
    terms = F.filter(F.split(F.trim(F.regexp_replace(fold("query"), TOKEN_GAP, " ")), " "), lambda t: t != "")
    return queries.select("query_id", terms.alias("terms")).select(
        "query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("pos", "qterm")
    )


def prefix_vocabulary(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(qterm, term)``: the indexed terms each query term is a prefix of.

    An equality join on the prefixes of the vocabulary, cut at the lengths that queries use.
    """
    wanted = terms.select("qterm").distinct()
    lengths = wanted.agg(F.collect_set(F.char_length("qterm")).alias("lengths"))
    prefixes = vocabulary.withColumn("lengths", lengths.scalar()).select(
        "term",
        F.explode(
            F.transform(
                F.filter("lengths", lambda n: n <= F.char_length("term")), lambda n: F.left(F.col("term"), n)
            )
        ).alias("qterm"),
    )
    return prefixes.join(wanted, "qterm")


def search_batch(
    index: DataFrame, stats: DataFrame, hidden_ids: DataFrame, queries: DataFrame, limit: int = CANDIDATES
) -> DataFrame:
    """``(query_id, id, score, rank)``: ``search_index`` for every row of ``(query_id, query)``.

    A common word sits in the postings of most bookmarks, so rows are never gathered by term: the
    query side is counted and broadcast, or salted by bookmark id when it is long, and counts are
    combined before they are shuffled. A query is driven from its rarest term. The steps that feed more than one other are written
    to the shared folder, which also gives the planner their true sizes.
    """
    terms = query_terms(queries)
    mapping = stage(prefix_vocabulary(terms, index.select("term").distinct()), "prefixes")
    hits = (
        sized_join(index.select("term", "id", "tf", "length"), mapping, "term", "id")
        .groupBy("qterm", "id")
        .agg(F.sum("tf").alias("freq"), F.max("length").alias("length"))
    )
    hits = stage(hits, "hits")
    frequencies = hits.groupBy("qterm").agg(F.count("*").cast("double").alias("df"))
    corpus = stats.select(F.struct("n", "mean_length"))
    weighed = terms.join(frequencies, "qterm").withColumn("corpus", corpus.scalar())
    weighed = stage(weighed.withColumn("weight", idf(F.col("corpus.n"), F.col("df"))), "weights")
    rank = Window.partitionBy("query_id").orderBy("df", "pos")
    placed = weighed.withColumn("place", F.row_number().over(rank))
    found_terms = F.count("*").over(Window.partitionBy("query_id"))
    placed = stage(placed.withColumn("known", found_terms).filter("known = n_terms").drop("known"), "places")
    part = term_score(F.col("weight"), F.col("freq").cast("double"), F.col("length"), F.col("corpus.mean_length"))
    # Only rows of a query's rarest term can match; the other terms are looked up for these.
    rare = sized_join(hits, placed.filter("place = 1"), "qterm", "id").select("query_id", "id", part.alias("score"), "n_terms")
    rest = placed.filter("place > 1").select("query_id", "qterm", "weight", "corpus")
    asked = sized_join(rare.filter("n_terms > 1").select("query_id", "id"), rest, "query_id", "id")
    others = asked.join(hits, ["qterm", "id"]).select("query_id", "id", part.alias("score"))
    scored = (
        rare.select("query_id", "id", "score", "n_terms")
        .unionByName(others.withColumn("n_terms", F.lit(0)))
        .groupBy("query_id", "id")
        .agg(F.sum("score").alias("score"), F.count("*").alias("found"), F.max("n_terms").alias("n_terms"))
        .filter(F.col("found") == F.col("n_terms"))
        .join(hidden_ids.select("id"), "id", "left_anti")
    )
    return top_ranked_by_query(scored, limit)
