"""Fingerprints, tokens, languages, toxicity, lines and mixing against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import bpe, langid, lines, mixing, queries, simhash, toxicity
from linkloom.llm.common import components, labelled

from .conftest import SF_DIR

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain_components(nodes, links):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("half", [16, 200])
def test_components_of_a_two_sided_chain(spark, half):
    """Ids rise along one half of the chain and fall along the other: a label would have to walk all of it."""
    path = list(range(half, 2 * half)) + list(range(half - 1, -1, -1))
    chain = spark.createDataFrame([(a, b) for a, b in zip(path, path[1:])], "a long, b long")
    found, rounds = labelled(chain)
    assert {(r["node"], r["root"]) for r in found.collect()} == {(n, 0) for n in path}
    assert rounds <= 2 + np.log2(2 * half)


def test_components_of_random_paths(spark):
    draw = random.Random(3)
    nodes = list(range(300))
    draw.shuffle(nodes)
    links = [(a, b) for a, b in zip(nodes, nodes[1:]) if draw.random() < 0.9]
    found, rounds = labelled(spark.createDataFrame(links, "a long, b long"))
    root = plain_components({n for link in links for n in link}, links)
    assert {r["node"]: r["root"] for r in found.collect()} == root and rounds <= 10


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (4, 3)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_op4_equals_plain(spark, documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = {k: plain_fingerprint(t or "") for k, t in rows.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    root = plain_components(prints, links)
    found = queries.op4_simhash_near_dedup(spark, SF_DIR).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found} == {(k, f"{p:016x}", root[k]) for k, p in prints.items()}
    assert any(r["doc_id"] != r["component_id"] for r in found)


@pytest.mark.parametrize("tree_rows", [3, 4096])
def test_links_connect_what_plain_links_connect(spark, tree_rows):
    draw = random.Random(3)
    values = {0, 1 << 63}
    for _ in range(12):
        centre = draw.getrandbits(64)
        values |= {centre ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) for _ in range(8)}
    values = {v % (1 << 64) for v in values}
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(frame, 2, tree_rows).collect()]
    plain = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    assert plain_components(values, found) == plain_components(values, plain)
    assert len(simhash.block_masks(1 << 40, 2)) > len(simhash.block_masks(10, 2)) == 3


def test_simhash_odd_rows(spark, odd_documents):
    found = simhash.near_copies(odd_documents).collect()
    assert len(found) == odd_documents.count()
    by_key = {r["doc_id"]: r for r in found}
    assert [by_key[k]["fp"] for k in (1, 2, 3)] == [0, 0, 0] and by_key[3]["component_id"] == 1
    assert simhash.near_copies(odd_documents.limit(0)).isEmpty()


def test_bpe_equals_library():
    encoder, library = bpe.Encoder(bpe.Vocabulary.load(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    texts = [
        "", " ", "Hello<|endoftext|>World's it'll ΑΣ ΣΑΣ İstanbul ½ 12 x²", "a\x1cb\x1d c", "é é", "<|startoftext|><|endoftext|> ",
        "日本語 👩‍👩‍👧", "x" * 5000, "ab" * 3000 + "'s", "​﻿ a b", "1" * 300, "!?" * 300, "\x00 a\x00", "ﬁ Ǆ",
    ]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert encoder.decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_op3_equals_library(spark, documents):
    library = Tokenizer.from_file(VOCABULARY)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for r in documents.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in queries.op3_bpe(spark, SF_DIR).collect()} == want


def test_bpe_odd_rows(spark, odd_documents):
    encoded = bpe.encode(odd_documents, VOCABULARY)
    rows = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert rows[1] == rows[2] == rows[3] == [] and len(rows[4]) == 60_001
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, VOCABULARY).collect()}[None] == "1</w> 2</w> 3</w> 4</w>"
    assert bpe.digests(odd_documents.limit(0), VOCABULARY).isEmpty()


def test_op8_held_out_accuracy(spark, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    found = [r for r in queries.op8_language_id(spark, SF_DIR).collect()]
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(truth) and all(0 <= r["score"] <= 1 for r in found)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_langid_odd_rows(spark, odd_documents):
    profiles = langid.learn(odd_documents)
    found = langid.predict(odd_documents, profiles)
    assert found.columns.count("lang_pred") == 1 and "size" in found.columns
    rows = {r["doc_id"]: r["lang_pred"] for r in found.collect()}
    assert (rows[1], rows[2], rows[None], rows[4], rows[7]) == ("und", "und", "und", "en", "fr")
    nothing = langid.learn(odd_documents.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd_documents, nothing).collect()} == {"und"}
    assert langid.predict(odd_documents.limit(0), profiles).isEmpty()


def test_ties_at_the_limit_go_by_code_point(spark, monkeypatch):
    monkeypatch.setattr(langid, "KEPT_WORDS", 5)
    rows = [(1, "often often b é a", "x"), (2, "z ü often c twice twice", "x"), (3, "one two", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.learn(docs).places[0]
    assert set(known) == {"often", "twice", "a", "b", "c", "one", "two"}


def test_unseen_word_backs_off():
    profiles = langid.Profiles(("a", "b"), ({"known": 0}, {}, {" z": 1}, {}, {}, {}), np.array([[0.0, -9.0], [-9.0, 0.0], [0.0, 0.0]]))
    assert profiles.evidence("known") == [0] and profiles.evidence("zebra") == [1] and profiles.evidence("qq") == [2]


def test_maximal_segments_equal_definition():
    draw = random.Random(5)
    for _ in range(200):
        scores = np.array([draw.choice([-3.0, -2.0, -1.0, 1.0, 2.0, 3.0]) for _ in range(draw.randrange(1, 14))])
        found = []

        def split(low, high):
            best = max(((scores[i:j].sum(), i - j, i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=None)
            if best and best[0] > 0:
                _, _, i, j = best
                found.append((i, j, best[0]))
                split(low, i)
                split(j, high)

        split(0, len(scores))
        got = toxicity.maximal_segments(scores)
        assert abs(sum(s for *_, s in got) - sum(s for *_, s in found)) < 1e-9
        assert all(abs(scores[s:e].sum() - v) < 1e-9 for s, e, v in got)


def test_op1_finds_toxic_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in queries.op1_toxicity(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in toxic]
    hits = Counter((r["predicted"], toxic[r["doc_id"]]) for r in held)
    assert hits[1, 1] / (hits[1, 1] + hits[0, 1]) > 0.85 and hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.85


def test_toxicity_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 1), (None, 1), (6, None), (7, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd_documents, labels)
    found = toxicity.score(odd_documents, model).collect()
    assert len(found) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in found)
    untaught = toxicity.learn(odd_documents, labels.limit(0))
    assert {r["score"] < 0.3 for r in toxicity.score(odd_documents, untaught).collect()} == {True}
    assert toxicity.score(odd_documents.limit(0), model).isEmpty()


def test_lines_equal_earlier_and_near(spark):
    base = "A line that is long enough to be compared."
    rows = [(2, f"{base}\nkept"), (1, f"{base}\n\nSecond line of the first text."), (3, base.replace("long", "lung") + "\nLes.\nLet."), (4, "  " + base)]
    found = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k]["text"] for k in (1, 2, 3, 4)] == [rows[1][1], "kept", "Les.\nLet.", ""]
    assert (found[3]["n_near"], found[3]["n_links"], found[1]["n_links"], found[4]["n_equal"]) == (1, 1, 1, 1)


def test_copies_of_a_line_have_its_links(spark):
    base = "A line that is long enough to be compared."
    rows = [(1, base), (2, f"first\n {base}"), (3, base), (4, base.replace("long", "lung")), (None, f"\n{base}\t")]
    pairs, members = lines.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 0, 4, 0)]
    assert {tuple(r) for r in members.collect()} == {
        (1, 0, 1, 0, 1), (2, 0, 2, 0, 0), (2, 1, 1, 0, 1), (3, 0, 1, 0, 1), (4, 0, 4, 0, 1), (None, 1, 1, 0, 1),
    }


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_join_equals_plain(spark, edits):
    draw = random.Random(edits)
    texts = set()
    for _ in range(25):
        base = "".join(draw.choice("abé𝄞") for _ in range(draw.randint(20, 30)))
        for _ in range(4):
            changed = list(base)
            for _ in range(draw.randint(0, edits + 1)):
                at = draw.randrange(len(changed))
                changed[at : at + draw.choice([0, 1, 1])] = draw.choice([[], ["a"], ["𝄞"]])
            texts.add("".join(changed))
    texts = sorted(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    found = {(r["earlier"]["doc"], r["later"]["doc"]) for r in lines.near_links(docs, edits, 10).collect()}
    assert found == {(i, j) for j in range(len(texts)) for i in range(j) if plain_distance(texts[i], texts[j]) <= edits}


def test_lines_odd_rows(spark, odd_documents):
    found = lines.dedup(odd_documents)
    assert found.columns.count("n_lines") == 1 and "row" in found.columns and found.count() == odd_documents.count()
    texts = sorted((r["doc_id"], r["text"]) for r in found.collect() if r["doc_id"] in (2, 3, 5, 6))
    assert [t for _, t in texts] == ["", " \t\n"] + ["The same line of text stands here.\nOther words follow it now."] * 2 + [""]
    assert lines.dedup(odd_documents.limit(0)).isEmpty()


def test_mix_odd_rows(spark, odd_documents):
    weights = spark.createDataFrame([(4, 0.0), (5, 3.0), (5, 1.0), (None, 2.0)], "doc_id long, weight double")
    rows = mixing.mix(odd_documents, quality=weights).collect()
    assert len(rows) == odd_documents.count() and all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    assert sum(t for t, _ in {(r["target"], r["source"]) for r in rows}) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert mixing.mix(odd_documents.limit(0)).isEmpty()


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 1000)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    assert found["a"] == 20.0 and found[None] == 2000.0 and found["b"] == pytest.approx(2 * found["c"])


def test_mix_takes_near_the_target(spark):
    found = queries.op10_source_mix(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id"
    )
    sums = found.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["t"] - r["target"]) <= r["most"] for r in sums)


def test_bpe_looks_at_few_matches_of_a_word():
    """A match for each token taken, not all of a word's matches: making them up was most of the time of new words."""
    encoder, seen = bpe.Encoder(bpe.Vocabulary.load(VOCABULARY)), []

    class Noting:
        def __init__(self, matcher):
            self.matcher = matcher

        def __getattr__(self, name):
            return lambda *given: (seen.append(m) or m for m in getattr(self.matcher, name)(*given))

    encoder.matcher = Noting(encoder.matcher)
    ids = [encoder.word(w.encode()) for w in ("thattherretionsbnghtkaw", "xqzvbrionalishmentarx", "erünsÄtthäusern")]
    assert len(seen) <= 2 * sum(map(len, ids))
