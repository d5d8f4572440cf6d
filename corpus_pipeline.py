"""A training corpus from raw documents, in stages that are written and read again one by one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import bpe, langid, lines, mixing, simhash
from linkloom.llm.common import table
from linkloom.llm.queries import quality_weights
from linkloom.session import stage

def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: null texts and texts without letters.

    The profiles are learnt from the documents' own languages, and ``lang`` becomes the predicted one.
    """
    found = langid.predict(docs, langid.learn(docs))
    kept = found.where(F.col("lang_pred") != langid.UNDETERMINED)
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat earlier ones, and documents of which nothing is left by that."""
    found = lines.dedup(docs)
    left = (F.length(F.btrim("text", F.lit(lines.BLANK + "\n"))) > 0) | ((F.col("n_equal") == 0) & (F.col("n_near") == 0))
    return found.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


#: Keys of rows up to this number (some 60 MB) are broadcast after a count; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that the SimHash operator links (three-word shingles, two differing bits).

    It is the row with the smallest id; a null id comes last, so a group of null ids keeps one of its rows and
    other groups are not touched by it. Rows that repeat an id are told apart by a hash of the whole row; of rows
    that are equal throughout one stays. Null, empty and wordless texts are one group. No rows give no rows.
    """
    hashes = [F.xxhash64(*docs.columns).alias("h"), F.xxhash64(F.lit("g"), *docs.columns).alias("g")]
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), *hashes)
    rows = docs.withColumn("_place", place)
    found = simhash.near_copies(rows.select("_place", "text"), key="_place")
    kept = F.col("_place") == F.col("component_id")
    marked = found.groupBy("_place").agg(F.bool_and(kept).alias("kept"), F.count("*").alias("n"))
    # Only what goes, and rows that repeat each other, are looked up; all others pass without a shuffle of texts.
    marked = stage(marked.where("NOT kept OR n > 1").select("_place", "kept"), "other-rows")
    known = F.broadcast(marked) if marked.count() <= BROADCAST_KEYS else marked
    single = rows.join(known.select("_place"), "_place", "left_anti")
    repeated = rows.join(known.where("kept").select("_place"), "_place", "left_semi").dropDuplicates(["_place"])
    return single.unionByName(repeated).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that repeat an id are mixed one by one, and a null source
    is a source. Documents without words are taken as their source's epochs have it. No rows give no rows."""
    mixed = mixing.mix(docs, quality=quality_weights(table(spark, sf_dir, "labels")))
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of what they decode to. A null text has no tokens;
    repeated ids stay separate rows. No rows give no rows."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(docs, vocabulary, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("lines", distinct_lines),
    ("near_copies", one_of_each_group),
    ("mix", mixed_sources),
    ("tokens", encoded),
]

#: SQL has no way to state the language profiles; the tests hold every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
