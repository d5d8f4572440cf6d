"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, embed_dedup, langid, licences, lines, mixing, pii, repair, simhash, sql, toxicity, whitening
from ..session import stage
from .common import fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(fold("doc_id", 4) != 2))
    found = toxicity.score(docs, model)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    held_out = (fold("doc_id", 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "score", predicted, F.size("passages").alias("n_passages"))


#: The conversation that says the template's own marks.
MARKS = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(
        F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(MARKS)
    )
    formatted = stage(chat.format_turns(chat.by_schema(rows.union(marks))), "formatted")
    read = chat.read_back(formatted)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    answers = F.array_join("answers", "")
    digests = read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(answers).cast("long").alias("loss_chars"),
        F.sha2(answers, 256).alias("loss_sha256"),
    )
    sizes = formatted.select(F.col("conv_id").alias("c"), F.length("formatted").cast("long").alias("formatted_chars"))
    return digests.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_equal(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *lines.ADDED, F.sha2("text", 256).alias("text_sha256"))


def op6_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(table(spark, sf_dir, "documents"))[0]


def op6_line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classes(table(spark, sf_dir, "documents"))[1]


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.learn(docs))
    base_kinds = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: s["kind"])
    counts = [
        (F.size(base_kinds) - F.size(F.array_remove(base_kinds, kind))).cast("long").alias(f"n_{kind}")
        for kind in pii.BASE_KINDS
    ]
    base = F.sha2(pii.listed("spans", base_only=True), 256).alias("base_sha256")
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    every = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, base, pii.listed("spans").alias("spans"), secrets, every)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(fold("doc_id", 5) != 0))
    found = langid.predict(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Documents marked as good count double, those marked as bad half."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return labels.select("doc_id", weight.alias("weight"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, quality=quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = whitening.whiten(vectors.select("vec_id", whitening.fixed_point("embedding").alias("fixed")))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fifth of their rows lost, emptied, cut, doubled or given to the user, by a hash of the key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    spoken = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(text("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    return marked.select("conv_id", "turn", role.alias("role"), spoken.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    broken = damaged(rows)
    planned = stage(repair.plans(broken), "repair-plans")
    found = planned.join(repair.digests(broken, planned).withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")))
    every = rows.select(F.col("conv_id").alias("_conv")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("n_rows").isNotNull(), "left").select(
        F.col("_conv").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda m: m["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_bpe": op3_bpe,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op6_line_pairs": op6_line_pairs,
    "op6_line_members": op6_line_members,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_source_mix": op10_source_mix,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
}

#: Counts of a few letters; two edits change their sum of differences by four at most.
LETTER_COUNTS = ", ".join(f"length(line) - length(replace(line, '{c}', '')) AS c{i}" for i, c in enumerate(lines.COUNTED))
LETTERS_APART = " + ".join(f"abs(a.c{i} - b.c{i})" for i in range(len(lines.COUNTED)))

#: All lines that are not blank with their class, and the links between classes.
LINE_CLASSES = """
WITH raw AS (
  SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS whole
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), lines AS (
  SELECT doc_id, pos, trim(whole, ' ' || chr(9) || chr(13)) AS line FROM raw
), firsts AS (
  SELECT *, row_number() OVER w AS copy, first_value(doc_id) OVER w AS class_doc, first_value(pos) OVER w AS class_line
  FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY line ORDER BY doc_id NULLS LAST, pos)
), sized AS (
  SELECT doc_id, pos, line, length(line) AS n, COUNTS FROM firsts WHERE copy = 1 AND length(line) >= 20
), links AS (
  SELECT a.doc_id AS earlier_doc, a.pos AS earlier_line, b.doc_id AS later_doc, b.pos AS later_line
  FROM sized a JOIN sized b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
    AND NEAR <= 4
  WHERE levenshtein(a.line, b.line) <= 2
)
""".replace("COUNTS", LETTER_COUNTS).replace("NEAR", LETTERS_APART)

ORACLE = {
    "op12_conversation_repair": sql.REPAIR,
    "op13_license_scan": sql.licence_scan(licences.build_index(), licences.ANCHORS),
    "op6_line_pairs": LINE_CLASSES + "SELECT * FROM links",
    "op6_line_members": LINE_CLASSES + """
, degrees AS (
  SELECT d, l, count(*) AS n FROM (SELECT earlier_doc AS d, earlier_line AS l FROM links UNION ALL SELECT later_doc, later_line FROM links) GROUP BY d, l
)
SELECT f.doc_id, f.pos AS line_no, f.class_doc, f.class_line, coalesce(g.n, 0)::BIGINT AS n_links
FROM firsts f LEFT JOIN degrees g ON g.d = f.class_doc AND g.l = f.class_line
""",
    "op2_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), named AS (
  SELECT conv_id, turn, text, CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END AS role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + (SELECT sum(length(x) + (length(x) - length(replace(x, chr(92), '')))
                 + 2 * ((length(x) - length(replace(x, '<s>', ''))) // 3 + (length(x) - length(replace(x, '</s>', ''))) // 4
                        + (length(x) - length(replace(x, '[INST]', ''))) // 6 + (length(x) - length(replace(x, '[/INST]', ''))) // 7))
            FROM (SELECT unnest([role, text]) AS x)))::BIGINT AS formatted_chars
FROM named GROUP BY conv_id
""",
    "op5_embedding_near_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(reach.b) AS component_id, vec_id = min(reach.b) AS kept
FROM embeddings JOIN reach ON reach.a = vec_id GROUP BY vec_id
""",
    "op6_line_dedup": """
WITH split AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), raw AS (
  SELECT doc_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS whole FROM split
), lines AS (
  SELECT *, trim(whole, ' ' || chr(9) || chr(13)) AS line FROM raw
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, pos) AS copy FROM lines
), sized AS (
  SELECT doc_id, pos, line, length(line) AS n, COUNTS
  FROM firsts WHERE copy = 1 AND length(line) >= 20
), links AS (
  SELECT a.doc_id AS d1, a.pos AS pos1, b.doc_id AS d2, b.pos AS pos2
  FROM sized a JOIN sized b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
    AND NEAR <= 4
  WHERE levenshtein(a.line, b.line) <= 2
), near AS (
  SELECT DISTINCT d2 AS doc_id, pos2 AS pos FROM links
), degrees AS (
  SELECT d AS doc_id, count(*) AS n FROM (SELECT d1 AS d FROM links UNION ALL SELECT d2 FROM links) GROUP BY d
), marked AS (
  SELECT f.doc_id, f.pos, f.whole, f.line <> '' AND f.copy > 1 AS same, n.pos IS NOT NULL AS close_by
  FROM firsts f LEFT JOIN near n ON n.doc_id = f.doc_id AND n.pos = f.pos
)
SELECT m.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (WHERE same) AS n_equal,
       count(*) FILTER (WHERE close_by) AS n_near, coalesce(any_value(g.n), 0) AS n_links,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(string_agg(whole, chr(10) ORDER BY pos) FILTER (WHERE NOT same AND NOT close_by), '')) END AS text_sha256
FROM marked m JOIN documents d ON d.doc_id = m.doc_id LEFT JOIN degrees g ON g.doc_id = m.doc_id
GROUP BY m.doc_id, d.text
""".replace("COUNTS", LETTER_COUNTS).replace("NEAR", LETTERS_APART),
    "op10_source_mix": r"""
WITH best AS (
  SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS weight
  FROM labels GROUP BY doc_id
), docs AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
           / coalesce(b.weight, 1.0::DOUBLE) AS place
  FROM documents d LEFT JOIN best b USING (doc_id)
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight
  FROM docs GROUP BY source
), filling AS (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS most,
         (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
         sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sources WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)
), targets AS (
  SELECT source, source_size, least(most, max((budget - filled) / open) OVER () * weight) AS target FROM filling
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets
), units AS (
  SELECT source, place, doc_id, size, sum(size) AS unit FROM docs GROUP BY ALL
), placed AS (
  SELECT *, coalesce(sum(unit) OVER (PARTITION BY source ORDER BY place, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM units
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.epochs + (u.before + u.unit / 2.0::DOUBLE <= p.target - p.epochs * p.source_size)::BIGINT))::BIGINT AS taken
FROM docs d
JOIN plan p ON p.source IS NOT DISTINCT FROM d.source
JOIN placed u ON u.source IS NOT DISTINCT FROM d.source AND u.doc_id IS NOT DISTINCT FROM d.doc_id
  AND u.size = d.size AND u.place = d.place
""",
}
