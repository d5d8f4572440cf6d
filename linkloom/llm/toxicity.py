"""Toxic passages: maximal scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import MEMO_ENTRIES, map_batches, spread_order

#: Labelled rows of each label that the model is fitted on: a fixed pseudo-random choice by key, the only bound.
SAMPLE_ROWS = 8_000
#: Features kept for the model, those with the strongest evidence first.
KEPT_FEATURES = 60_000
#: Word beginnings that back up a word's own counts, shortest first.
STEMS = (3, 4, 5, 6)
#: Strength of the Dirichlet prior: every level counts this many documents at the rate of the level above.
PRIOR_DOCUMENTS = 10.0
#: Taken from every log-odds, so that tokens without evidence pull a segment down.
DRIFT = 0.8
#: Log-odds are cut off here in both directions, so that one token alone says only so much.
LARGEST = 5.0
#: A passage is significant when fewer than this many are expected in a clean text of the same length.
SIGNIFICANT = 0.05
EULER = 0.5772156649015329

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def levels(word: str) -> list[str]:
    """The word's beginnings, marked as such, and last the word itself."""
    return [word[:n] + "*" for n in STEMS if len(word) >= n] + [word]


@dataclass(frozen=True)
class ToxicityModel:
    """Log-odds per token level and the extreme-value law of clean texts.

    ``rates`` has the class-balanced share of toxic documents among those with a feature; ``scale`` and
    ``log_k`` are the parameters of Karlin and Altschul's law; ``weights`` turn evidence into a probability.
    """

    counts: dict[str, tuple[float, float]]
    scale: float
    log_k: float
    weights: tuple[float, float, float]

    def log_odds(self, word: str) -> float:
        rate = 0.5
        for level in levels(word):
            toxic, clean = self.counts.get(level, (0.0, 0.0))
            rate = (toxic + PRIOR_DOCUMENTS * rate) / (toxic + clean + PRIOR_DOCUMENTS)
        return max(-LARGEST, min(LARGEST, math.log(rate / (1 - rate))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, in one pass.

    After Ruzzo and Tompa: every positive score opens a segment, which swallows earlier ones as long as
    that raises its sum. Runs without positive scores are skipped over by their sum.
    """
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[list[float]] = []  # start, end, sum before start, sum up to end, nearest earlier with a smaller left sum
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = at, at + 1, float(upto[at]), float(upto[at + 1])
        while True:
            before = len(held) - 1
            while before >= 0 and held[before][2] >= left:
                before = int(held[before][4])
            if before < 0 or held[before][3] >= right:
                held.append([start, end, left, right, before])
                break
            start, left = int(held[before][0]), held[before][2]
            del held[before:]
    return [(int(s), int(e), right - left) for s, e, left, right, _ in held]


def evidence(scores: np.ndarray, scale: float, log_k: float) -> tuple[list[tuple[int, int, float]], float, float]:
    """Significant passages with their bit scores, the largest bit score and the significant sum.

    A passage's bit score is scale * sum - log(K * length): the expected number of passages as good in a
    clean text of that length is exp(-bits).
    """
    found = maximal_segments(scores)
    if not found:
        return [], -LARGEST, 0.0
    floor = log_k + math.log(max(1, len(scores)))
    bits = [(s, e, scale * score - floor) for s, e, score in found]
    strong = [x for x in bits if x[2] >= -math.log(SIGNIFICANT)]
    return strong, max(-LARGEST, max(b for _, _, b in bits)), math.fsum(b for _, _, b in strong)


class Reader:
    """Token scores of texts; remembers the words it has seen."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.memo = model, {}

    def scores(self, text: str | None) -> np.ndarray:
        found = tokens(text) if text else []
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {}
        get = self.memo.get
        values = [get(w) for w in found]
        if None in values:
            for w in {w for w, v in zip(found, values) if v is None}:
                self.memo[w] = self.model.log_odds(w) - DRIFT
            values = [self.memo[w] for w in found]
        return np.array(values, float)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The probability that a text is toxic and its significant passages (first token, end, bits)."""
        passages, best, total = evidence(self.scores(text), self.model.scale, self.model.log_k)
        a, b, c = self.model.weights
        return float(_logistic(a + b * best + c * math.log1p(total))), passages


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit_logistic(features: np.ndarray, labels: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton steps with a small ridge; the first column is 1."""
    weights, ridge = np.zeros(features.shape[1]), 1e-2 * np.eye(features.shape[1])
    for _ in range(rounds):
        p = _logistic(features @ weights)
        hessian = (features * (p * (1 - p))[:, None]).T @ features + ridge
        weights = weights + np.linalg.solve(hessian, features.T @ (labels - p) - ridge @ weights)
    return weights


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from the texts of ``docs`` whose key has a 0 or 1 in ``labels`` (repeated keys: the largest).

    About ``rows`` documents of each label are chosen by a fixed hash of the key, which bounds the table of
    chosen keys and with it the broadcast. Two thirds of them give the log-odds, the others the calibration.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel({}, 1.0, 0.0, (-20.0 if sizes.get(1, 0) == 0 else 20.0, 0.0, 0.0))
    share = F.when(F.col("label") == 1, min(1.0, rows / sizes[1])).otherwise(min(1.0, rows / sizes[0]))
    chosen = known.where(spread_order("key") < share).withColumn("checks", F.pmod(F.xxhash64("key"), F.lit(3)) == 0)
    body = F.col(text).cast("string").alias("text")
    sample = docs.select(F.col(key).alias("key"), body).where("text is not null").join(F.broadcast(chosen), "key")
    sample = stage(sample, "labelled")
    counts = _feature_counts(sample.where("not checks"))
    toxic_docs, clean_docs = (max(1, sample.where(f"not checks and label = {v}").count()) for v in (1, 0))
    balance = toxic_docs / clean_docs
    surprise = F.abs(F.log((F.col("toxic") + 0.5) / (F.col("clean") * F.lit(balance) + 0.5))) * F.sqrt(F.col("toxic") + F.col("clean"))
    top = counts.where("toxic + clean > 1").orderBy(F.desc(surprise), "feature").limit(KEPT_FEATURES).collect()
    features = {r["feature"]: (float(r["toxic"]), r["clean"] * balance) for r in top}
    return _calibrated(ToxicityModel(features, 1.0, 0.0, (0.0, 1.0, 0.0)), sample.where("checks"), sizes)


def _feature_counts(sample: DataFrame) -> DataFrame:
    """In how many toxic and clean documents each feature occurs."""

    def counting():
        def step(batch: pa.RecordBatch) -> list[list]:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update({level for word in set(tokens(text)) for level in levels(word)})
            names = list(toxic.keys() | clean.keys())
            return [names, [toxic[n] for n in names], [clean[n] for n in names]]

        return step

    counts = map_batches(sample.select("text", "label"), counting, "feature string, toxic long, clean long")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _calibrated(model: ToxicityModel, held: DataFrame, sizes: dict[int, int]) -> ToxicityModel:
    """Fits the extreme-value law on clean texts and the final probability on both labels."""
    held_model = held.sparkSession.sparkContext.broadcast(model)

    def measuring():
        reader = Reader(held_model.value)

        def step(batch: pa.RecordBatch) -> list[list]:
            labels, lengths, sums, tallies = batch.column(1).to_pylist(), [], [], []
            for text in batch.column(0).to_pylist():
                scores = reader.scores(text)
                lengths.append(len(scores))
                sums.append(sorted((x[2] for x in maximal_segments(scores)), reverse=True))
                tallies.append(np.histogram(scores, bins=200, range=(-LARGEST - DRIFT, LARGEST))[0].tolist())
            return [labels, lengths, sums, tallies]

        return step

    rows = map_batches(held.select("text", "label"), measuring, "label int, length long, sums array<double>, tally array<long>").collect()
    if not rows:
        return model
    clean = [r for r in rows if not r["label"] and r["length"]]
    edges = np.linspace(-LARGEST - DRIFT, LARGEST, 201)
    tally = np.sum([r["tally"] for r in clean], axis=0) if clean else np.zeros(200)
    scale = _tally_scale(tally, (edges[1:] + edges[:-1]) / 2)
    best = [scale * (r["sums"] or [0.0])[0] - math.log(r["length"]) for r in clean]
    log_k = float(np.mean(best)) - EULER if best else 0.0
    features, labels = [], []
    for r in rows:
        floor = log_k + math.log(max(1, r["length"]))
        bits = [scale * s - floor for s in r["sums"]]
        total = math.fsum(b for b in bits if b >= -math.log(SIGNIFICANT))
        features.append([1.0, max([-LARGEST, *bits]), math.log1p(total)])
        labels.append(float(r["label"]))
    found, given = np.array(features), np.array(labels)
    if len(set(labels)) < 2:
        return ToxicityModel(model.counts, scale, log_k, model.weights)
    weights = _fit_logistic(found, given)
    # the sample is balanced by choice; the offset returns to the labels' own rate
    weights[0] += math.log(sizes[1] / sizes[0]) - math.log(given.sum() / (len(given) - given.sum()))
    return ToxicityModel(model.counts, scale, log_k, tuple(map(float, weights)))


def _tally_scale(tally: np.ndarray, centres: np.ndarray) -> float:
    """The positive root of mean(exp(scale * score)) = 1 over clean tokens, whose scores come counted in
    bins; 1 where their mean is not negative."""
    if not tally.sum():
        return 1.0
    share = tally / tally.sum()
    if share @ centres >= 0 or not tally[centres > 0].any():
        return 1.0
    low, high = 1e-6, 1.0
    while share @ np.exp(high * centres) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if share @ np.exp(middle * centres) < 1 else (low, middle)
    return high


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, passages`` of every row; a passage is (first token, end token, bits).

    Whole texts are read. Null and empty texts have no passage and the score of a text without evidence.
    Rows that repeat a key stay; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def transform():
        reader = Reader(shared.value)

        def step(batch: pa.RecordBatch) -> list:
            found = [reader.score(t) for t in batch.column(1).to_pylist()]
            passages = [[{"first": s, "end": e, "bits": b} for s, e, b in p] for _, p in found]
            return [batch.column(0), [f[0] for f in found], passages]

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, score double, passages array<struct<first:long,end:long,bits:double>>"
    return map_batches(docs.select(F.col(key), F.col(text).cast("string")), transform, schema)
