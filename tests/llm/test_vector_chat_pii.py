"""Vectors, chat formats and personal data against plain versions and on odd rows; the pipeline's stages."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import ann, chat, embed_dedup, pii, queries

from .conftest import SF_DIR


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.2], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0),
        (8, [inf, 1.0], 0), (9, [], 0), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 0), (13, [1.0, 0.0], 0), (14, [0.0, 1.0], 0),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "7 AS id", "'x' AS vector", "0 AS n")


def test_near_equal_odd_rows(spark, odd_vectors):
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_equal(odd_vectors).collect()}
    assert len(found) == 14
    assert [found[k] for k in (1, 2, 3, 13)] == [(3, 1, True), (3, 1, False), (3, 1, False), (3, 1, False)]
    assert all(found[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12, 14))
    assert embed_dedup.near_equal(odd_vectors.limit(0)).isEmpty()


def test_near_equal_equals_plain(spark, monkeypatch):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(30, 16))
    vectors = np.repeat(centres, 8, axis=0) + draw.normal(size=(240, 16)) * draw.choice([0.1, 0.4], size=(240, 1))
    labels = draw.integers(0, 2, 240)
    rows = [(i, [float(x) for x in v], int(y)) for i, (v, y) in enumerate(zip(vectors, labels))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", 50)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (units @ units.T >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(240, dtype=bool)
    root = np.arange(240)
    for _ in range(240):
        root = np.minimum(root, np.where(linked, root[None, :], 240).min(axis=1))
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_equal(frame).collect()}
    assert found == {i: (int(linked[i].sum()), int(root[i])) for i in range(240)} and linked.any()


def test_near_equal_length_outside_the_sample(spark, monkeypatch):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0, float(i)], 0) for i in (1, 2, 3)] + [(4, [1.0, 0.1], 0), (6, [0.0, 0.1, 0.2], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embed_dedup, "SAMPLE_ROWS", 1)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_equal(frame).collect()}
    assert found == {1: (2, 1), 3: (2, 1), 4: (2, 1), 2: (1, 2), 6: (1, 2)}


def test_tile_against_itself_in_another_order():
    draw = np.random.default_rng(2)
    vectors = np.repeat(draw.normal(size=(6, 4)), 5, axis=0) + draw.normal(size=(30, 4)) * 0.1
    tile = pa.table({"id": list(range(30)), "copies": [1] * 30, "vector": vectors.tolist(), "tile": ["t"] * 30})
    want = embed_dedup.compare(tile, tile, np.eye(4), 0.93).to_pydict()
    assert max(want["n"]) > 1
    for _ in range(3):
        assert embed_dedup.compare(tile, tile.take(pa.array(draw.permutation(30))), np.eye(4), 0.93).to_pydict() == want


def test_search_odd_rows(spark, odd_vectors):
    found = ann.search(odd_vectors, odd_vectors.where("vec_id in (1, 4, 12)"), k=3, factor=1.0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: (r["query_id"], r["rank"]))] == [
        (1, 1, 2, 2.0), (1, 2, 3, 1.0), (1, 3, 10, 1.0),
    ]
    assert ann.search(odd_vectors.limit(0), odd_vectors).isEmpty()


def test_factor_one_is_exact_and_production_recall(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    asked = ids % 20 == 0
    products = vectors[asked] @ vectors.T
    products[ids[asked][:, None] == ids[None, :]] = -np.inf
    best = [set(ids[np.lexsort((ids, -p))[:20]].tolist()) for p in products]
    tree = ann.VantageTree(vectors, np.linalg.norm(vectors, axis=1).max(), leaf_rows=16)
    exact, _ = tree.search(vectors[asked], ids[asked], ids, 20, 1.0)
    assert [set(ids[e].tolist()) for e in exact] == best
    found: dict[int, set] = {}
    for r in queries.op9_nearest_neighbours(spark, SF_DIR).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len(found[q] & b) / 20 for q, b in zip(ids[asked].tolist(), best)])
    assert recall >= 0.95


def test_layouts_are_told_apart(spark):
    records = [
        {"messages": [{"role": "human", "content": "q"}, {"role": "gpt", "content": "a"}]},
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "x", "output": "o"},
        {"conversations": [{"from": "user", "value": "v"}]}, {"system": "s", "prompt": "p", "response": "r"}, {"other": 1}, {"messages": "text"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, "{broken"), (99, None)]
    found = {r["conv_id"]: r for r in chat.by_record(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    turns = {k: [tuple(t) for t in r["turns"]] for k, r in found.items()}
    assert turns[0] == [("user", "q"), ("assistant", "a")] and turns[1] == [("user", "p"), ("assistant", "r")]
    assert turns[2] == [("user", "i"), ("assistant", "o")] and turns[3] == [("user", "i\n\nx"), ("assistant", "o")]
    assert turns[4] == [("user", "v")] and turns[5][0] == ("system", "s")
    assert [found[k]["layout"] for k in (6, 7, 98, 99)] == [None] * 4 and turns[6] == turns[99] == []


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", "</s>[INST] \\. \\ <s>"), (1, 0, None, None), (None, 0, "user", "x"), (2, None, "[INST]", "a" * 100_000), (2, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(chat.by_schema(table))
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("", ""), ("assistant", "</s>[INST] \\. \\ <s>")]
    assert back[1]["answers"] == ["</s>[INST] \\. \\ <s>"] and back[2]["answers"] == [""] and back[2]["turns"][0]["role"] == "[INST]"
    inside = [r["formatted"].count("</s>") for r in formatted.where("conv_id = 1").collect()]
    assert inside == [2]
    with pytest.raises(ValueError):
        chat.by_schema(table.withColumn("more", F.lit(1)))
    assert chat.format_turns(chat.by_schema(table.withColumn("more", F.lit(1)).limit(0), ignore=("more",))).isEmpty()


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    found = {}
    for kind, rule in RULES.items():
        found[kind] = []
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            found[kind].append(m.span())
    return found


def test_base_rules_equal_plain(documents):
    texts = [r["text"] or "" for r in documents.collect()] + [
        "a@b.c@d.e.f", "@@a@b..c a@b.c.", "1.2.3.4.5.6.7.8.9", "1.2.3.4567 255.255.255.255", "x.y@-.-", "4111 1111 1111 1111 1",
        "+1 (415) 555-2671 +", "1.2.3.4.", "0001.0255.3.4", "+12((( 3", "a.b@c.d%e@f.g", "4111-1111 1111-1111",
    ]
    assert [pii.base_spans(t) for t in texts] == [plain_base(t) for t in texts]
    pii.candidates("a1" * 50_000 + "1" * 50_000 + "1." * 30_000 + "@" * 1000 + "+1" * 10_000 + "(" * 5_000)


def test_op7_keeps_base_spans(spark, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in queries.op7_pii(spark, SF_DIR).collect():
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in RULES] == [len(base[k]) for k in RULES]
        listed = set(filter(None, r["spans"].split(",")))
        assert {f"{k}:{s}:{e}" for k, spans in base.items() for s, e in spans} <= listed


def test_pii_odd_rows(spark, odd_documents):
    model = pii.learn(odd_documents)
    assert {len(r["spans"]) for r in pii.find(odd_documents, model).collect()} == {0}
    mail = "Mail é@x a.b@c.de now"
    docs = spark.createDataFrame([(1, mail, "x"), (2, None, "x"), (None, mail, "x"), (1, "a.b@c.de", "x")], "doc_id long, text string, spans string")
    found = pii.redact(docs, pii.learn(docs.limit(0))).collect()
    want = [(1, "<email>", "x"), (1, "Mail é@x <email> now", "x"), (2, None, "x"), (None, "Mail é@x <email> now", "x")]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert pii.redact(docs.limit(0), pii.learn(docs.limit(0))).isEmpty()


def test_extra_labels():
    def labels(text):
        return {(k, text[s:e]): pii.rule_label(text, k, s, e) for k, s, e in pii.candidates(text)}

    found = labels("Write jane.doe at mail dot de or ask (call 555 123 4567), fe80::1:2: or 12:30:45:10, (415) 555-2671, 3782.822463.10005, tim at noon.so")
    assert {c for c, label in found.items() if label} == {
        ("email", "jane.doe at mail dot de"), ("phone", "555 123 4567"), ("ip", "fe80::1:2"), ("phone", "(415) 555-2671"), ("card", "3782.822463.10005"),
    }
    assert labels("key=" + "a1B2c3D4" * 40) == {("secret", "a1B2c3D4" * 40): 1}


def test_planted_extra_spans_are_found(spark):
    draw = np.random.default_rng(5)
    number = lambda n: "".join(map(str, draw.integers(2, 10, n)))
    plants = {
        "email": lambda: f"user{number(2)} at mail{number(1)} dot {draw.choice(['com', 'org', 'net'])}",
        "ip": lambda: ":".join(f"{x:x}" for x in draw.integers(4096, 65536, 8)),
        "phone": lambda: f"({number(3)}) {number(3)}-{number(4)}",
        "card": lambda: next(c for c in (f"37{number(2)} {number(6)} {number(5)}" for _ in range(1000)) if pii.luhn(pii.digits_of(c))),
        "secret": lambda: "key=" + "".join(draw.choice(list("abcdefgh2345678"), 140)),
    }
    rows, planted = [], set()
    for i in range(600):
        text = f"On {number(4)}-{number(2)} at {number(2)}:{number(2)}:{number(2)}:{number(2)} we sold {number(7)} and {number(14)} pieces at home. "
        if i % 2:
            kind = list(plants)[i // 2 % 5]
            body = plants[kind]()
            start = len(text) + (4 if kind == "secret" else 0)
            planted.add((i, kind, start, len(text) + len(body)))
            text += body + " was given."
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in pii.find(docs, pii.learn(docs)).collect() for s in r["spans"] if not s["base"]}
    counts = {kind: sum(c[1] == kind for c in planted & found) for kind in plants}
    print("planted spans found of 60 each:", counts, "others:", len(found - planted))
    assert min(counts.values()) >= 54 and len(found - planted) <= 0.02 * len(found)


def test_trees_learn_a_rule():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(400, 3))
    labels = ((rows[:, 0] > 0.2) & (rows[:, 1] < 0.5)).astype(float)
    model = pii.boost(rows, labels)
    assert np.mean([(model.probability(r) > 0.5) == bool(y) for r, y in zip(rows.tolist(), labels)]) > 0.97


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [docs.count()]
    for _, apply in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.stage(apply(spark, docs, SF_DIR), "test")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] >= 0.98 * counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == counts[-1] and {"n_tokens", "ids", "decoded_sha256"} <= set(last.columns)
    assert corpus_pipeline.STAGES[2][1](spark, docs.limit(0), SF_DIR).isEmpty()


def test_learning_counts_every_candidate(spark):
    """No document and no candidate is left out, on coarser grids neither."""
    rows = [(i, f"call +44 20 {i:04d} 1234, card 4111 1111 1111 1111, ") for i in range(300)]
    rows.append((300, " ".join(f"10.0.{n // 250}.{n % 250}" for n in range(2000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = sum(len(pii.candidates(text)) for _, text in rows)
    assert every > 2500
    counted = pii.counted_candidates(docs, "doc_id", "text")
    halved = pii._halved(counted)
    assert [c.agg({"n": "sum"}).first()[0] for c in (counted, halved)] == [every, every]
    assert halved.count() < counted.count()
    assert len(pii.learn(docs, rows=halved.count()).grids[1]) < len(pii.finest_grids()[1])
