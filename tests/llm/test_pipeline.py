"""The pipeline's stages against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from .conftest import SF_DIR
from .test_text_operators import plain_distance, plain_fingerprint

near_stage = dict(corpus_pipeline.STAGES)["near_copies"]


def plain_kept(rows):
    """Of each group of linked rows the first by (id is null, id)."""
    prints, root = [plain_fingerprint(t or "") for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    groups = {}
    for r, row in zip(root, rows):
        groups.setdefault(r, []).append(row)
    return sorted((min((k is None, k or 0) for k, _ in g), len(g)) for g in groups.values())


def edited_copies():
    draw = random.Random(7)
    rows = []
    for base in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([60, 120, 300]))]
        for _ in range(6):
            changed = list(words)
            for _ in range(draw.randrange(len(words) // 60 + 1)):
                changed[draw.randrange(len(words))] = f"v{draw.randrange(5000)}"
            rows.append((len(rows) + 1, " ".join(changed)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("few_keys", [0, 1_000_000])
def test_near_copies_by_fingerprint(spark, monkeypatch, few_keys):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", few_keys)
    rows = edited_copies()
    want = [first for first, _ in plain_kept(rows)]
    kept = near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == want and 12 < len(want) < len(rows)


def test_one_row_of_each_group(spark):
    texts = {n: " ".join(f"{n}{i}" for i in range(40)) for n in "abcde"}
    near = texts["a"] + "\t\n"
    rows = [
        (3, texts["a"], "x"), (3, texts["a"], "x"), (3, texts["a"], "y"), (None, near, "x"), (4, near, "x"), (None, texts["b"], "x"), (None, texts["b"], "x"),
        (None, texts["c"], "x"), (5, texts["d"], None), (5, texts["e"], None), (6, texts["d"].upper(), "x"), (7, None, "x"), (8, "", "x"), (None, " ", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r["doc_id"], r["text"]) for r in near_stage(spark, docs, SF_DIR).collect()]
    want = [(3, texts["a"]), (None, texts["b"]), (None, texts["c"]), (5, texts["d"]), (5, texts["e"]), (7, None)]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_odd_documents_through_every_stage(spark, odd_documents):
    docs, sizes = odd_documents, {}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.stage(apply(spark, docs, SF_DIR), "odd")
        assert docs.columns == columns
        sizes[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"][:9]) for r in docs.collect())
    same, other = (False, 5, "The same "), (True, 0, "12 34")
    assert sizes["language"] == [(False, 4, "word word"), same, same, (False, 6, "The same "), (False, 7, "xxxxxxxxx")]
    assert sizes["lines"] == [(False, 4, "word word"), same, same, (False, 7, "xxxxxxxxx")]
    assert sizes["near_copies"] == [(False, 4, "word word"), same, (False, 7, "xxxxxxxxx")]
    assert other not in sizes["language"] and corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


def plain_lines(rows):
    """Rows ``(id, text)`` in the order of ids without lines that equal, or are at most two edits from, earlier ones."""
    seen, kept = [], {}
    for key, text in sorted(rows):
        left, changed = [], False
        for line in text.split("\n"):
            form = line.strip(" \t\r")
            if form in (s for s, _ in seen):
                changed = True
                continue
            near = bool(form) and any(len(form) >= 20 and len(s) >= 20 and abs(len(s) - len(form)) <= 2 and close(c, form) and plain_distance(s, form) <= 2 for s, c in seen)
            seen += [(form, Counter(form))] if form else []
            changed |= near
            left += [] if near else [line]
        body = "\n".join(left)
        if body.strip(" \t\r\n") or not changed:
            kept[key] = body
    return kept


def close(counts, line):
    other = Counter(line)
    return sum((counts - other).values()) + sum((other - counts).values()) <= 4


def test_stages_equal_plain(spark, documents):
    """Lines, near copies and tokens on the documents and edited copies; language keeps what has letters."""
    columns = documents.columns
    given = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    most = max(k for k, _ in given)
    extra = [(most + k, t) for k, t in edited_copies()] + [(most + 1000, "12 34")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    more = more.select(*[c if c in ("doc_id", "text") else F.lit("en" if c == "lang" else None).cast(documents.schema[c].dataType).alias(c) for c in columns])
    docs = corpus_pipeline.stage(documents.union(more), "plain")
    stages = dict(corpus_pipeline.STAGES)
    read = lambda rows: {r["doc_id"]: r["text"] for r in rows.collect()}
    told = corpus_pipeline.stage(stages["language"](spark, docs, SF_DIR), "told")
    assert read(told) == {k: t for k, t in given + extra if t and re.search(r"[^\W\d_]", t)}
    left = corpus_pipeline.stage(stages["lines"](spark, told, SF_DIR), "left")
    assert read(left) == plain_lines(read(told).items())
    kept = corpus_pipeline.stage(stages["near_copies"](spark, left, SF_DIR), "kept")
    assert sorted((False, k) for k in read(kept)) == [first for first, _ in plain_kept(list(read(left).items()))]
    assert kept.count() < left.count()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: list(r["ids"]) for r in stages["tokens"](spark, kept, SF_DIR).collect()}
    assert ids == {k: library.encode(t, add_special_tokens=False).ids for k, t in read(kept).items()}
