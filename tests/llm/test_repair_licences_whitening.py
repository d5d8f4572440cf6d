"""Conversation repair, licence scan and whitening against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import feast, licences, queries, repair, whitening

from .conftest import SF_DIR

LEGAL = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """Cheapest edits by a search over all of them: (cost, audit, texts) for rows of (role, text, fault)."""
    best = []
    queue = [(0, "", 0, ())]
    seen = set()
    while queue:
        cost, audit, at, kept = heapq.heappop(queue)
        letters = "".join(k[0][:1] or "-" for k in kept)
        if best and cost > best[0][0]:
            break
        if at == len(rows) and LEGAL.fullmatch(letters):
            best.append((cost, audit, kept))
            continue
        if (at, audit) in seen or not any(LEGAL.fullmatch(letters + rest) for rest in ("", "a", "ua")):
            continue
        seen.add((at, audit))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 3, audit + "I", at, kept + ((role, ""),)))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, kept))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, kept + ((role, text),)))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 3, audit + "R", at + 1, kept + ((new, text),)))
    return min(best, key=lambda b: b[:2])


def faulty(rows):
    found, before = [], set()
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in before else "" if last in ".!?" else "truncated"
        before.add((role, text))
        found.append((role, text, fault))
    return found


def test_repair_equals_search(spark):
    draw = np.random.default_rng(7)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["Yes.", "No", "", " \t", "What?", "Well!\n"]
    talks = [[(str(draw.choice(roles, p=[0.35, 0.3, 0.15, 0.15, 0.05])), str(draw.choice(texts))) for _ in range(n)] for n in draw.integers(1, 6, 120)]
    rows = [(i, t, role, text) for i, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    planned = repair.plans(frame)
    found = {r["conv_id"]: r for r in planned.collect()}
    made = {i: [] for i in range(len(talks))}
    for r in repair.repaired(frame, planned).orderBy("conv_id", "place").collect():
        made[r["conv_id"]].append((r["role"], r["text"]))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(frame, planned).collect()}
    for i, talk in enumerate(talks):
        rows = faulty(talk)
        cost, audit, kept = plain_repair(rows)
        assert (found[i]["cost"], found[i]["audit"]) == (cost, audit), talk
        assert tuple(made[i]) == kept
        assert digests[i] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        for name in ("blank", "duplicate", "truncated"):
            assert found[i][name] == sum(f == name for *_, f in rows)


def test_repair_odd_rows(spark):
    rows = [
        (None, None, "user", "Hi."), (None, 2**60 + 1, "assistant", "x" * 300_000 + "."), (2**60 + 3, 5, None, None), (2, 1, "user", "A."),
        (2, 1, "user", "A."), (2, 1, "assistant", "B."), (2, 9, "user", "A."), (2, None, "user", "A."),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS kind", "'k' AS audit", "0 AS place")
    planned = repair.plans(frame)
    found = {r["conv_id"]: r for r in planned.collect()}
    assert [found[None][c] for c in ("gaps", "illegal", "cost", "audit")] == [0, 0, 0, "KK"]
    assert [found[2**60 + 3][c] for c in ("gaps", "blank", "truncated", "cost", "audit")] == [0, 1, 0, 4, "D"]
    # By turn, nulls first, then by role: user A., assistant B., user A. twice, user A.
    assert [found[2][c] for c in ("n_rows", "gaps", "duplicate", "cost", "audit")] == [5, 7, 3, 12, "KKDDD"]
    turns = repair.repaired(frame, planned)
    assert sorted(r["turn"] or 0 for r in turns.where("conv_id IS NULL").collect()) == [0, 2**60 + 1]
    assert {r["conv_id"] for r in repair.digests(frame, planned).collect()} == {None, 2, 2**60 + 3}
    empty = frame.limit(0)
    assert repair.plans(empty).isEmpty() and repair.repaired(empty, repair.plans(empty)).isEmpty()


def test_notes_spill_and_are_read_in_blocks(monkeypatch):
    draw = np.random.default_rng(1)
    rows = [(int(t), str(draw.choice(["user", "assistant", "system"])), bool(draw.random() < 0.1), False, bool(draw.random() < 0.3)) for t in range(3_000)]

    def planned():
        talk = repair._Conversation(1, repair._Steps())
        for row in reversed(rows):
            talk.add(*row)
        spilled = getattr(talk.notes, "_rolled", False)
        return talk.plan(), spilled

    in_memory, spilled = planned()
    assert not spilled
    monkeypatch.setattr(repair, "SPILL_BYTES", 100)
    monkeypatch.setattr(repair, "BLOCK", 64)
    on_disk, spilled = planned()
    assert spilled and on_disk == in_memory and len(in_memory[-1]) >= 3_000


def plain_scan(text, index):
    words = licences.split(text or "")
    stands = lambda p: [i for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    base = [(label, i) for label, phrase in index.base for i in stands(phrase)]
    labels, score = {label for label, _ in base}, 1.0 if base else 0.0
    for notice in index.notices:
        shared = [w for w in notice.ranked if w in words]
        rare = shared[: licences.ANCHORS]
        if len(rare) < min(licences.ANCHORS, len(notice.ranked)):
            continue
        begins = [{i - p for i, x in enumerate(words) if x == w for p in notice.postings[w]} for w in rare]
        if set.intersection(*begins) and all(stands(p) for p in notice.phrases):
            labels.add(notice.label)
            score = max(score, len(shared) / len(notice.ranked))
    return len(words), sorted(i for _, i in base), sorted(labels), score


LICENCE_TEXTS = [
    "Released under the MIT License. mit  LICENSE, mit-license", "MIT_License", "mit license", "GNU General\nPublic License, version 3",
    "Apache License, Version 2.0 apache license", "license mit license license", "CC BY-NC 4.0", "Licensed under CC BY-NC 4.0.", "CC BY 4.0 and CC0 1.0 Universal",
    *[f"Before it. {notice} And after it." for _, notice, _ in licences.NOTICES], *[notice[len(notice) // 3 :] for _, notice, _ in licences.NOTICES],
]


def test_licences_equal_plain(spark, documents):
    index = licences.build_index()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(LICENCE_TEXTS)], "doc_id long, text string")
    some = frame.union(documents.select(F.col("doc_id") + 1000, "text"))
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    for r in licences.scan(some).collect():
        starts = sorted(m["start"] for m in r["matches"] if m["base"])
        assert (r["n_words"], starts, r["labels"], r["score"]) == plain_scan(texts[r["doc_id"]], index), texts[r["doc_id"]]
    every = {label for r in licences.scan(frame).collect() for label in r["labels"]}
    assert every == {n[0] for n in licences.NOTICES} | {b[0] for b in licences.BASE}


def test_licences_odd_documents(spark, odd_documents):
    found = licences.scan(odd_documents.withColumn("labels", F.lit("x")).withColumn("_at", F.lit(1)))
    rows = found.collect()
    assert len(rows) == 9 and all(r["labels"] == [] and r["score"] == 0 and r["matches"] == [] for r in rows)
    assert {r["doc_id"]: r["n_words"] for r in rows}[4] == 60_001
    assert licences.scan(odd_documents.limit(0)).isEmpty()
    hot = spark.createDataFrame([(1, "license " * 30_000 + "mit license")], "doc_id long, text string")
    assert [m["start"] for m in licences.scan(hot).first()["matches"]] == [30_000]


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_largest_eigenpairs(size):
    draw = np.random.default_rng(size)
    half = draw.normal(size=(size, size + 3))
    matrix = half @ half.T
    values, vectors = feast.largest(matrix, 32)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:32], rtol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * values[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_clusters_and_missing_rank():
    turn, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(40, 40)))
    spectrum = np.array([1e6] + [5.0] * 20 + [1.0] * 10 + [1e-3] * 3 + [0.0] * 6)
    values, _ = feast.largest((turn * spectrum) @ turn.T, 32)
    assert np.allclose(values, spectrum[:32], rtol=1e-6)
    values, _ = feast.largest(np.diag([3.0, 0.0, 2.0]), 32)
    assert np.allclose(values, [3, 2])
    assert len(feast.largest(np.zeros((4, 4)), 32)[0]) == 0
    for shift, above in ((-1, 40), (0.5, 31), (3, 21), (6, 1), (2e6, 0)):
        assert feast.above((turn * spectrum) @ turn.T, shift) == above


def test_products_are_exact():
    values = np.array([[1, 2**40 + 1], [2**24, -(2**40)], [3, 5]], dtype=np.int64)
    plain = [[sum(int(r[i]) * int(r[j]) for r in values) for j in range(2)] for i in range(2)]
    assert whitening.products(values).tolist() == plain


def test_whitening_equals_plain(spark):
    found = queries.op11_embedding_whitening(spark, SF_DIR).toPandas().sort_values(["component", "vec_id"])
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = (n * x - sums).astype(np.float64) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    plain = apart @ vectors / np.sqrt(values)
    ours = found["whitened"].to_numpy().reshape(32, n).T
    assert np.allclose(np.abs((ours * plain).mean(axis=0)), 1, atol=1e-9)
    assert np.allclose(ours * np.sign((ours * plain).sum(axis=0)), plain, atol=1e-8)
    assert found["deviation"].tolist()[:n] == ((n * x - sums) ** 2).sum(axis=1).tolist()
    assert np.allclose(found["explained"].to_numpy()[::n], values / np.trace(apart.T @ apart / n), rtol=1e-9)
    assert (found["n"] == n).all() and found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [2.0, 0.5], [2.0, 0.5], [0.0, -1.0], None, [1.0, None], [nan, 1.0], [inf, 0.0], [], [0.0, 0.0], [1.0, 2.0, 3.0], [1e300, 0.0]]
    rows = [(None if i == 3 else i, v) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "'x' AS whitened", "2 AS length")
    fixed = frame.withColumn("fixed", whitening.fixed_point("embedding"))
    found = whitening.whiten(fixed).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["component"]) for r in found) == sorted(itertools.product([0, 1, 2, -1, 9], [1, 2]))
    assert {r["n"] for r in found} == {5} and max(r["identity_error"] for r in found) < 1e-9
    assert whitening.whiten(fixed.limit(0)).isEmpty()
    same = spark.createDataFrame([(1, [5, 5]), (2, [5, 5])], "vec_id long, fixed array<bigint>")
    assert whitening.whiten(same).isEmpty()
