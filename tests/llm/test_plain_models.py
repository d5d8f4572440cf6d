"""Scores of the learnt models against plain versions of the same formulas."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from linkloom.llm import langid, queries, toxicity
from linkloom.llm.common import fold

from .conftest import SF_DIR

WORD = re.compile(r"[^\W\d_]+")


def plain_profiles(rows):
    """Log frequencies by size (0: words) and item, one per language, from rows of (language, text)."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for word in WORD.findall(text.lower()):
            counts[lang, 0][word] += 1
            marked = f" {word} "
            for size in range(1, 6):
                for at in range(len(marked) - size + 1):
                    counts[lang, size][marked[at : at + size]] += 1
    kept = {}
    for (lang, size), found in counts.items():
        limit = langid.KEPT_WORDS if size == 0 else langid.KEPT_GRAMS
        kept[lang, size] = dict(sorted(found.items(), key=lambda c: (-c[1], c[0]))[:limit])
    languages = sorted({lang for lang, _ in counts})
    totals = {k: sum(c.values()) for k, c in counts.items()}
    table = {}
    for size in range(6):
        for item in set().union(*[kept.get((lang, size), {}) for lang in languages]):
            table[size, item] = [math.log(kept[lang, size].get(item, 0.5) / (totals[lang, size] + 1)) for lang in languages]
    return languages, table


def plain_language(text, languages, table):
    words = WORD.findall((text or "").lower())
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    sums = [0.0] * len(languages)
    for word in words:
        rows = [table[0, word]] if (0, word) in table else []
        for size in range(5, 0, -1):
            if rows:
                break
            marked = f" {word} "
            rows = [table[size, marked[i : i + size]] for i in range(len(marked) - size + 1) if (size, marked[i : i + size]) in table]
        for i in range(len(languages)):
            sums[i] += sum(r[i] for r in rows) / len(rows) if rows else 0.0
    mean = [s / max(1, len(words)) * min(max(1, len(words)), langid.EVIDENCE_WORDS) for s in sums]
    odds = [math.exp(m - max(mean)) for m in mean]
    best = max(range(len(odds)), key=lambda i: (odds[i], -i))
    return languages[best], odds[best] / sum(odds)


def test_language_equals_plain(spark, documents):
    rows = documents.withColumn("learnt", fold("doc_id", 5) != 0).collect()
    languages, table = plain_profiles([(r["lang"], r["text"]) for r in rows if r["learnt"] and r["lang"] is not None and r["text"] is not None])
    texts = {r["doc_id"]: r["text"] for r in rows}
    found = queries.op8_language_id(spark, SF_DIR).collect()
    assert len(found) == len(texts)
    for r in found:
        lang, score = plain_language(texts[r["doc_id"]], languages, table)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9


def plain_toxicity(text, model):
    """Score by the definition: log-odds through ever longer word beginnings, segments by splitting at the best one."""
    scores = []
    for word in WORD.findall((text or "").lower()):
        rate = 0.5
        for level in [word[:n] + "*" for n in (3, 4, 5, 6) if len(word) >= n] + [word]:
            toxic, clean = model.counts.get(level, (0, 0))
            rate = (toxic + 10 * rate) / (toxic + clean + 10)
        scores.append(max(-5, min(5, math.log(rate / (1 - rate)))) - 0.8)
    sums = []

    def split(low, high):
        best = max(((sum(scores[i:j]), i - j, i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0,))
        if best[0] > 0:
            sums.append(best[0])
            split(low, best[2])
            split(best[3], high)

    split(0, len(scores))
    floor = model.log_k + math.log(max(1, len(scores)))
    bits = [model.scale * s - floor for s in sums]
    total = sum(b for b in bits if b >= -math.log(0.05))
    a, b, c = model.weights
    return 1 / (1 + math.exp(-(a + b * max([-5, *bits]) + c * math.log1p(total))))


def test_toxicity_equals_plain(spark):
    """Whole short texts: the plain version looks at all pairs of places."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.learn(docs, labels.where(fold("doc_id", 4) != 2))
    short = docs.where(F.size(F.split("text", " ")) <= 70)
    texts = {r["doc_id"]: r["text"] for r in short.collect()}
    found = {r["doc_id"]: r["score"] for r in toxicity.score(short, model).collect()}
    assert len(found) == len(texts) > 50 and max(found.values()) > 0.5 > min(found.values())
    for key, text in texts.items():
        assert abs(found[key] - plain_toxicity(text, model)) < 1e-6
