"""Language of a text: known words first, then ever shorter character n-grams for unseen words."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import MEMO_ENTRIES, map_batches, spread_order

#: Documents per language that the model learns from. A fixed pseudo-random choice by key; the only bound.
SAMPLE_PER_LANGUAGE = 1_000
#: Words and n-grams kept per language, the most frequent first (ties: code-point order).
KEPT_WORDS, KEPT_GRAMS = 20_000, 40_000
LONGEST_GRAM = 5
#: Words of a text that count as independent evidence when its score is stated.
EVIDENCE_WORDS = 30
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
#: Texts whose unseen words are scored together.
_GROUP = 256


def words(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _WORD.findall(text.lower())


def grams(word: str, size: int) -> list[str]:
    """Character n-grams of a word whose ends are marked with blanks."""
    marked = f" {word} "
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


@dataclass(frozen=True)
class Profiles:
    """Log frequencies per language. ``places[0]`` numbers the known words and ``places[n]`` the n-grams;
    the numbers are rows of ``table``, which has a column per language and zeros in its last row."""

    languages: tuple[str, ...]
    places: tuple[dict[str, int], ...]
    table: np.ndarray

    def evidence(self, word: str) -> list[int]:
        """Rows whose mean scores a word: its own, else those of its longest n-grams of which any is known."""
        own = self.places[0].get(word)
        if own is not None:
            return [own]
        for size in range(LONGEST_GRAM, 0, -1):
            place = self.places[size]
            found = [place[g] for g in grams(word, size) if g in place]
            if found:
                return found
        return [len(self.table) - 1]

    def scores(self, unseen: list[str]) -> np.ndarray:
        """A row of log frequencies for every word."""
        rows = [self.evidence(w) for w in unseen]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((r for found in rows for r in found), np.int64, int(counts.sum()))
        return np.add.reduceat(self.table[flat], np.cumsum(counts) - counts) / counts[:, None]


def sampled(docs: DataFrame, key: str, lang: str, per_language: int) -> DataFrame:
    """A fixed choice of about ``per_language`` rows of each language."""
    counts = stage(docs.groupBy(F.col(lang).alias("lang")).count(), "languages")  # a small written table joins without a shuffle
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    picked = docs.alias("d").join(counts.select("lang", share.alias("share")).alias("c"), F.col(f"d.{lang}") == F.col("c.lang"))
    return picked.where(spread_order(f"d.{key}") < F.col("share")).select("d.*")


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles from the rows of ``docs`` that have a text and a language.

    Spark counts words per language over whole sampled texts; the driver gets the most frequent words
    and n-grams of each language only, so its share is bounded by the parameters above.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sample = sampled(labelled, key, lang, per_language)

    def counting():
        def step(batch: pa.RecordBatch) -> list[list]:
            found: Counter[tuple[str, str]] = Counter()
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((name, w) for w in words(body))
            return [[k[0] for k in found], [k[1] for k in found], list(found.values())]

        return step

    counts = map_batches(sample.select(F.col(lang), F.col(text)), counting, "lang string, word string, n long")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    parts = [F.transform(F.array(F.col("word")), lambda w: F.struct(F.lit(0).alias("size"), w.alias("item")))]
    marked = F.concat(F.lit(" "), "word", F.lit(" "))
    for size in range(1, LONGEST_GRAM + 1):
        starts = F.sequence(F.lit(1), F.length("word") + 2 - (size - 1))
        items = F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), F.substr(marked, i, F.lit(size)).alias("item")))
        parts.append(F.when(F.length("word") + 2 >= size, items).otherwise(F.slice(items, 1, 0)))
    pieces = counts.select("lang", "n", F.explode(F.concat(*parts)).alias("p")).select("lang", "n", "p.*")
    totals = stage(pieces.groupBy("lang", "size", "item").agg(F.sum("n").alias("n")), "grams")
    return _profiles(_most_frequent(totals))


def _most_frequent(totals: DataFrame) -> list:
    """The kept items of each language and size, with the sum of all counts of that language and size.

    The cut is by count, and among items of the count at which the limit is reached by code point. Counts are
    grouped first, so that only those of that one count are numbered; the sample bounds them.
    """
    limit = F.when(F.col("size") == 0, KEPT_WORDS).otherwise(KEPT_GRAMS)
    groups = totals.groupBy("lang", "size", "n").agg(F.count("*").alias("items"))
    falling = Window.partitionBy("lang", "size").orderBy(F.desc("n"))
    cuts = (
        groups.withColumn("upto", F.sum("items").over(falling))
        .groupBy("lang", "size")
        .agg(
            F.max(F.when(F.col("upto") > limit, F.col("n"))).alias("edge"),
            F.coalesce(F.max(F.when(F.col("upto") <= limit, F.col("upto"))), F.lit(0)).alias("above"),
            F.sum(F.col("n") * F.col("items")).alias("total"),
        )
    )
    cut = totals.join(cuts, ["lang", "size"])
    whole = cut.where("edge IS NULL OR n > edge")
    by_item = Window.partitionBy("lang", "size").orderBy("item")
    tied = cut.where("n = edge").withColumn("place", F.row_number().over(by_item)).where(F.col("place") <= limit - F.col("above"))
    names = ["lang", "size", "item", "n", "total"]
    return whole.select(*names).union(tied.select(*names)).collect()


def _profiles(kept: list) -> Profiles:
    """Log frequencies with half a count for items that a language does not have."""
    languages = tuple(sorted({r["lang"] for r in kept}))
    place = {name: i for i, name in enumerate(languages)}
    totals = {(r["size"], r["lang"]): r["total"] for r in kept}
    places: tuple[dict[str, int], ...] = tuple({} for _ in range(LONGEST_GRAM + 1))
    cells = []
    for r in sorted(kept, key=lambda r: (r["size"], r["item"])):
        own = places[r["size"]]
        cells.append((own.setdefault(r["item"], sum(map(len, places))), place[r["lang"]], r["n"]))
    counts = np.full((sum(map(len, places)), len(languages)), 0.5)
    for row, column, n in cells:
        counts[row, column] = n
    sizes = np.repeat(np.arange(LONGEST_GRAM + 1), [len(p) for p in places])
    base = np.array([[totals.get((size, name), 1) + 1.0 for name in languages] for size in range(LONGEST_GRAM + 1)])
    table = np.vstack([np.log(counts / base[sizes]), np.zeros(len(languages))])
    return Profiles(languages, places, table)


class Scorer:
    """Predicts texts with profiles; keeps the scores of the words it has seen."""

    def __init__(self, profiles: Profiles) -> None:
        self.profiles = profiles
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.profiles.languages)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For every text the language (ties: first in code-point order) and its posterior.

        The evidence of all words is averaged and counted as that of at most EVIDENCE_WORDS, since the
        words of a text go together.
        """
        found: list[tuple[str, float]] = []
        for at in range(0, len(texts), _GROUP):
            found += self._group(texts[at : at + _GROUP])
        return found

    def _group(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.place) > MEMO_ENTRIES:
            self.forget()
        tallies = []
        unseen: dict[str, int] = {}
        for text in texts:
            tally = Counter(words(text)) if text is not None else {}
            places = [self.place.get(w) for w in tally]
            if None in places:
                places = [unseen.setdefault(w, len(self.rows) + len(unseen)) if p is None else p for w, p in zip(tally, places)]
            tallies.append((np.array(places, np.int64), np.fromiter(tally.values(), float, len(tally))))
        if unseen:
            self.rows = np.vstack([self.rows, self.profiles.scores(list(unseen))])
            self.place.update(unseen)
        return [self._best(places, times, text) for (places, times), text in zip(tallies, texts)]

    def _best(self, places: np.ndarray, times: np.ndarray, text: str | None) -> tuple[str, float]:
        if not self.profiles.languages or not len(places) and not any(map(str.isalpha, text or "")):
            return UNDETERMINED, 0.0
        count = max(1.0, times.sum())
        mean = times @ self.rows[places] / count * min(count, EVIDENCE_WORDS)
        odds = np.exp(mean - mean.max())
        best = int(np.argmax(odds))
        return self.profiles.languages[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, profiles: Profiles, key: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (``und`` for a null text or one without letters) and ``score`` in [0, 1].

    Whole texts count. Columns of ``docs`` with the new names are replaced; all others stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    body = names.index(text)

    def transform():
        scorer = Scorer(model.value)

        def step(batch: pa.RecordBatch) -> list:
            found = scorer.predict(batch.column(body).cast(pa.string()).to_pylist())
            return [*batch.columns, [f[0] for f in found], [f[1] for f in found]]

        return step

    kept = docs.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(kept, transform, f"{fields}, lang_pred string, score double")
