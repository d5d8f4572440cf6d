"""Pluggable models, called once per Arrow batch.

A summary model maps a Series of prompts to a Series of responses; an embedder maps a Series of
texts to a Series of float lists, aligned by index. A missing element means the model failed on that row. Rows whose
input is NULL are never sent to a model. The two built-in models are deterministic and need no
service.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches
from .prompts import CONTENT_MARK
from .text import query_tokens

Model = Callable[[pd.Series], pd.Series]

HASH_WIDTH = 64
LEAD_KEYWORDS = 3
LEAD_MIN_CHARS = 4


def lead_summary(prompts: pd.Series) -> pd.Series:
    """First sentence of the page text, and its most frequent longer words as keywords."""
    return prompts.map(_lead_response)


def _lead_response(prompt: str) -> str:
    text = prompt.split(CONTENT_MARK, 1)[-1]
    counts = Counter(t for t in query_tokens(text) if len(t) >= LEAD_MIN_CHARS)
    words = sorted(counts, key=lambda t: (-counts[t], t))[:LEAD_KEYWORDS]
    sentence = re.match(r"[^.!?\n]*", text).group()
    return f"SUMMARY: {sentence}\nKEYWORDS: {', '.join(words)}"


def hash_embedding(texts: pd.Series, width: int = HASH_WIDTH) -> pd.Series:
    """Signed feature hashing of the tokens."""
    return texts.map(lambda text: _hash_vector(text, width))


def _hash_vector(text: str, width: int) -> np.ndarray:
    vector = np.zeros(width, dtype=np.float32)
    for token, n in Counter(query_tokens(text)).items():
        digest = hashlib.md5(token.encode("utf-8")).digest()
        sign = 1 if digest[7] % 2 == 0 else -1
        vector[int.from_bytes(digest[:4], "big") % width] += sign * n
    return vector


SUMMARY_MODELS: dict[str, Model] = {"lead": lead_summary}
EMBEDDERS: dict[str, Model] = {"hash": hash_embedding}


def summary_model(choice: str | Model) -> Model:
    """A model by name or as a callable; an unknown name is an error."""
    if callable(choice):
        return choice
    if choice not in SUMMARY_MODELS:
        raise ValueError(f"unsupported summary model: {choice}")
    return SUMMARY_MODELS[choice]


def embedder(choice: str | Model | None) -> Model | None:
    """As ``summary_model``; None leaves the embedding step out."""
    if choice is None or callable(choice):
        return choice
    if choice not in EMBEDDERS:
        raise ValueError(f"unsupported embedder: {choice}")
    return EMBEDDERS[choice]


def _call(model: Model, inputs: pd.Series) -> pd.Series:
    """Results aligned to ``inputs``; if a batch fails its rows are tried one by one.

    A model sees its inputs numbered from 0 and its answer is aligned by that number, so answers
    may come in any order and a missing number is a missing result.
    """
    places = np.flatnonzero(inputs.notna())
    results = pd.Series([None] * len(inputs), index=inputs.index, dtype=object)
    if not len(places):
        return results
    wanted = inputs.iloc[places].reset_index(drop=True)
    try:
        answers = dict(pd.Series(model(wanted), dtype=object).items())
    except Exception:
        answers = {i: _call_one(model, value) for i, value in wanted.items()}
    for i, place in enumerate(places):
        results.iat[place] = answers.get(i)
    return results


def _call_one(model: Model, value: str):
    try:
        return next(iter(model(pd.Series([value]))), None)
    except Exception:
        return None


def apply_model(model: Model, column: Column, returns: str) -> Column:
    """``model`` over a column. Marked nondeterministic so that a plan never calls it twice per row.

    Batches are limited in bytes, or a worker would hold thousands of whole texts at once.
    """
    bound_batches(SparkSession.active())

    @F.pandas_udf(returns)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield _call(model, batch)

    return call.asNondeterministic()(column)
