"""Licence scan by a positional index of rare licence words; DataFrame functions only, one pass, no shuffle.

The index knows the words of some licence notices: in which notices each stands, at which positions, and how rare
it is among them (IDF). A text is cut into words once. Of the words it shares with a notice those of the highest IDF
are looked up: every place of such a word, less a position of the word in the notice, says where the notice would
begin, and only beginnings on which all of these words agree are left. The notice is found if there is one and its
mandatory key phrases stand in the text. The three base phrases are notices whose every word must agree, so all their
places are found.

Everything a text needs is in its own row and in the index, a constant of this module: the scan does not depend on
other rows, and a frequent word, text or key makes no task longer than its own texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import computed_once

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

# Label, notice, mandatory key phrases. Notices are quoted from the licences themselves.
NOTICES = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software", ("granted free of charge", "without restriction")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("gpl-2.0", "GNU General Public License, version 2", ("general public license version 2",)),
    ("gpl-3.0", "GNU General Public License, version 3", ("general public license version 3",)),
    ("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "GNU Affero General Public License", ("affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
     ("mozilla public license v 2 0",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
     "License 2.0", ("eclipse public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted", ("with or without fee is hereby granted",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
     "be held liable for any damages arising from the use of this software.", ("express or implied warranty", "held liable")),
    ("unlicense", "This is free and unencumbered software released into the public domain.",
     ("free and unencumbered software",)),
    ("cc0", "CC0 1.0 Universal", ("cc0 1 0",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
)

#: Words of a notice that must agree on where it begins; all of them if it has fewer.
ANCHORS = 3


def split(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class Notice:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    #: Distinct words, rarest first, and where each stands.
    ranked: tuple[str, ...]
    postings: dict[str, tuple[int, ...]]


@dataclass(frozen=True)
class Index:
    notices: tuple[Notice, ...]
    base: tuple[tuple[str, tuple[str, ...]], ...]
    idf: dict[str, float]


def build_index(notices=NOTICES, base=BASE) -> Index:
    """Postings and IDF over the notices and base phrases; words of equal IDF rank by their first place."""
    cut = [(label, tuple(split(text)), tuple(tuple(split(p)) for p in phrases)) for label, text, phrases in notices]
    phrases = tuple((label, tuple(split(text))) for label, text in base)
    bodies = [set(words) for _, words, _ in cut] + [set(words) for _, words in phrases]
    every = sorted(set().union(*bodies, *[p for _, _, keys in cut for p in keys]))
    idf = {w: math.log(len(bodies) / max(1, sum(w in b for b in bodies))) for w in every}
    made = []
    for label, words, keys in cut:
        ranked = sorted(dict.fromkeys(words), key=lambda w: (-idf[w], words.index(w)))
        places = {w: tuple(i for i, x in enumerate(words) if x == w) for w in ranked}
        made.append(Notice(label, words, keys, tuple(ranked), places))
    return Index(tuple(made), phrases, idf)


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _word(at: Column) -> Column:
    """The word at a place counted from 0; null beyond the text."""
    return F.get("_words", at)


def _places(word: str) -> Column:
    return F.filter("_at", lambda i: _word(i) == word)


def _less(places: Column, k: int) -> Column:
    return F.transform(places, lambda i: i - k)


def _base_starts(phrase: tuple[str, ...]) -> Column:
    """Beginnings on which all words of a phrase agree, in order."""
    starts = _places(phrase[0])
    for k, word in enumerate(phrase[1:], 1):
        starts = F.array_intersect(starts, _less(_places(word), k))
    return starts


def _stands(phrase: tuple[str, ...], idf: dict[str, float]) -> Column:
    """Whether a phrase stands in the text: its words are read around each place of the rarest one."""
    k = max(range(len(phrase)), key=lambda i: (idf[phrase[i]], -i))
    here = lambda i: F.slice("_words", i - (k - 1), len(phrase)) == _texts(phrase)
    return F.exists(_places(phrase[k]), lambda i: F.when(i >= k, here(i)).otherwise(False))


def _begins(notice: Notice) -> Column:
    """Beginnings on which the text's rarest words of a notice agree; null where it has too few of them."""
    most = min(ANCHORS, len(notice.ranked))
    postings = F.create_map(*[x for w in notice.ranked for x in (F.lit(w), F.array(*[F.lit(p) for p in notice.postings[w]]))])
    shared = F.slice(F.array_intersect(_texts(notice.ranked), F.col("_present")), 1, most)

    def starts(anchor: Column) -> Column:
        places = F.filter("_at", lambda i: _word(i) == anchor)
        return F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(postings[anchor], lambda p: i - p))))

    agreed = F.aggregate(
        F.slice(shared, 2, max(1, most)), starts(F.get(shared, F.lit(0))), lambda left, anchor: F.array_intersect(left, starts(anchor))
    )
    return F.when(F.size(shared) == most, agreed)


def _matches(starts: Column, label: str, size: int, base: bool) -> Column:
    return F.transform(
        starts,
        lambda s: F.struct(
            F.lit(label).alias("label"), F.greatest(s, F.lit(0)).alias("start"), (s + size).alias("end"), F.lit(base).alias("base")
        ),
    )


_MATCH = "array<struct<label:string,start:int,end:int,base:boolean>>"


def scan(docs: DataFrame, text: str = "text", index: Index | None = None) -> DataFrame:
    """``docs`` without its text, plus ``n_words``, ``matches``, ``labels`` and ``score``.

    ``matches`` holds ``label, start, end, base`` with places in words, the end exclusive: every place of a base
    phrase, and the first place of each notice found (cut at 0 if its beginning is lost). ``labels`` are the distinct
    labels, sorted. ``score`` is 1 where a base phrase stands, otherwise the largest share of a found notice's words
    that the text has, 0 where nothing is found. A null text is an empty one and has no words; repeated rows and null
    keys each give their own row; columns of ``docs`` that bear the name of an added one are left out. No rows give
    no rows.
    """
    index = index or build_index()
    added = ("n_words", "matches", "labels", "score")
    keep = [c for c in docs.columns if c != text and c not in added]
    vocabulary = sorted(index.idf)
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    # What is kept travels as one column, so that no name of it can clash with those used here.
    packed = docs.select(F.struct(F.lit(0).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("_row"), text)
    cut = computed_once(packed, ["_row"], {"_words": F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))})
    known = F.array_compact(F.transform("_words", lambda w, i: F.when(w.isin(vocabulary), i)))
    placed = computed_once(cut, ["_row", "_words"], {"_at": known})
    seen = placed.withColumn("_present", F.array_distinct(F.transform("_at", _word)))

    base = [_matches(_base_starts(words), label, len(words), True) for label, words in index.base]
    shares, own = [], []
    for notice in index.notices:
        first = _matches(F.slice(F.array_sort(_begins(notice)), 1, 1), notice.label, len(notice.words), False)
        verified = F.lit(True)
        for phrase in notice.phrases:
            verified = verified & _stands(phrase, index.idf)
        own.append(F.when(verified, first))
        share = F.size(F.array_intersect(_texts(notice.ranked), F.col("_present"))) / F.lit(len(notice.ranked))
        shares.append((notice.label, share))
    nothing = F.array().cast(_MATCH)
    found = F.flatten(F.array(*[F.coalesce(x.cast(_MATCH), nothing) for x in (*base, *own)]))
    matched = computed_once(seen, ["_row", "_words", "_present"], {"matches": F.when(F.size("_at") > 0, found).otherwise(nothing)})
    labels = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["label"])))
    has = lambda label: F.exists("matches", lambda m: m["label"] == label)
    best = F.greatest(F.lit(0.0), *[F.when(has(label), share) for label, share in shares])
    score = F.when(F.exists("matches", lambda m: m["base"]), F.lit(1.0)).otherwise(best)
    kept = [F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(keep)]
    return matched.select(*kept, F.size("_words").cast("long").alias("n_words"), "matches", labels.alias("labels"), score.alias("score"))
