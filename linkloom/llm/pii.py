"""Personal data: generous candidate generators, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import bisect
import ipaddress
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_batches

#: Kinds in the order in which spans are listed; the first four have fixed base rules.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Different rows of snapped features that the trees are grown from; with more of them the grids get coarser.
TRAINING_ROWS = 60_000
#: Share of true spans among the redacted ones that a kind's threshold must keep on held-out candidates.
PRECISION = 0.98
CONTEXT = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses; each @ is looked at once, so that long runs of letters cost no more than their length."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = _left_run(text, at, _LOCAL, end)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def addresses(text: str) -> list[tuple[int, int, bool]]:
    """Runs of four numbers between dots, and whether no number is above 255."""
    found = []
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            parts = run[0].split(".")
            at = run.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                found.append((at, at + size, all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four)))
                at += size + 1
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the four base rules, each kind from left to right without overlaps; failing ones are dropped."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE_KINDS}
    if "@" in text:
        found["email"] = emails(text)
    found["ip"] = [(s, e) for s, e, valid in addresses(text) if valid]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


#: Generators propose far more than is personal data; their spans may overlap each other and the base spans.
#: Each starts from a rare sign (a digit, a colon, a spelt-out at), and each pass is linear in the text.
_CARD_LIKE = re.compile(r"[0-9](?<![0-9][0-9])(?:[ .-]{0,2}[0-9]){12,18}(?![0-9])")
_PHONE_LIKE = re.compile(r"[+(0-9](?<![0-9][+(0-9])(?:[ ().-]{0,2}[0-9]){6,15}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,7}(?:[0-9A-Fa-f]{1,4}|(?<=::))(?![0-9A-Za-z]|:[0-9A-Fa-f:])")
_SPELT_AT = re.compile(r"[ (\[{]at[ )\]}] ?(?=[\w-]{1,63}(?: ?[(\[{]dot[)\]}] ?| dot |\.)[\w-]{2})")
_SPELT_DOMAIN = re.compile(r"[\w-]{1,63}(?:(?: ?[(\[{]dot[)\]}] ?| dot |\.)[\w-]{2,24}){1,3}")
_SECRET_TAIL = re.compile(r"[0-9][A-Za-z0-9_/+-]*")
_SECRET_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+-")
_SECRET_CHARS = 20
#: Last labels of spelt-out domains that are taken for addresses; two letters are a country.
_TOP_LEVEL = frozenset("com net org edu gov mil int info biz name pro app dev cloud online site store tech email example test".split())
_COUNTRY = re.compile(
    "a[cdefgilmoqrstuwxz]|b[abdefghijmnorstvwyz]|c[acdfghiklmnoruvwxyz]|d[ejkmoz]|e[cegrstu]|f[ijkmor]|g[abdefghilmnpqrstuwy]"
    "|h[kmnrtu]|i[delmnoqrst]|j[emop]|k[eghimnprwyz]|l[abcikrstuvy]|m[acdeghklmnopqrstuvwxyz]|n[acefgilopruz]|om|p[aefghklmnrstwy]"
    "|qa|r[eosuw]|s[abcdeghijklmnorstuvxyz]|t[cdfghjklmnortvwz]|u[agksyz]|v[aceginu]|w[fs]|y[et]|z[amw]"
)
#: Ways to write a national number: an area code in brackets, three groups of 3-3-4, or groups after a leading 0.
_NATIONAL = re.compile(r"\([0-9]{2,5}\)[ -]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}")
#: Beginnings of numbers of the large issuers, and how many digits they have.
_ISSUED = re.compile(r"3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}")


def _left_run(text: str, at: int, letters: frozenset[str], floor: int) -> int:
    while at > floor and text[at - 1] in letters:
        at -= 1
    return at


def spelt_emails(text: str) -> list[tuple[int, int]]:
    found, floor = [], 0
    for m in _SPELT_AT.finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = _left_run(text, end, _LOCAL, floor)
        if start < end:
            floor = _SPELT_DOMAIN.match(text, m.end()).end()
            found.append((start, floor))
    return found


def long_mixes(text: str) -> list[tuple[int, int]]:
    """Long runs of letters, digits and a few signs that hold a digit."""
    found, floor = [], 0
    for m in _SECRET_TAIL.finditer(text):
        start = _left_run(text, m.start(), _SECRET_LETTERS, floor)
        floor = m.end()
        if floor - start >= _SECRET_CHARS:
            found.append((start, floor))
    return found


#: Numbers that ``features`` gives for a span.
N_FEATURES = 37

#: Words near a span that name its kind.
CUES = {
    "email": ("mail", "@", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "secret": ("key", "secret", "token", "password", "="),
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of all kinds, base spans among them, each once."""
    found = {(kind, s, e) for kind, spans in base_spans(text).items() for s, e in spans}
    found |= {("ip", s, e) for s, e, _ in addresses(text)}
    found |= {("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13}
    found |= {("card", *m.span()) for m in _CARD_LIKE.finditer(text)}
    found |= {("phone", *m.span()) for m in _PHONE_LIKE.finditer(text)}
    found |= {("ip", *m.span()) for m in _IP6.finditer(text)} if text.count(":") >= 2 else set()
    found |= {("email", *span) for span in spelt_emails(text)}
    found |= {("secret", *span) for span in long_mixes(text)}
    return sorted(found, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span. None of them is the outcome of a labelling rule (``extra_label``): the trees have
    to find what such spans look like in lengths, counts and shares of characters, groups and neighbours."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    digits, letters = digits_of(span), sum(map(str.isalpha, span))
    runs = re.split(r"[^0-9]+", span.strip("+( "))
    groups = [len(g) for g in re.findall(r"[A-Za-z0-9]+", span)]
    counts = [span.count(c) for c in set(span)]
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in counts)
    numbers = [int(r[:9]) for r in runs if r]
    first = [*map(len, runs), 0, 0, 0]
    signs = {c for c in span if not c.isalnum()}
    return [
        float(KINDS.index(kind)),
        float(len(span)),
        float(len(digits)),
        letters / len(span),
        float(sum(not c.isalnum() for c in span)),
        float(len(runs)),
        float(max(map(len, runs))),
        float(min(map(len, runs))),
        float(max(numbers, default=0)),
        float(luhn(digits)) if digits else 0.0,
        entropy,
        float(span.count("@")),
        float(span.count(".")),
        float(span.count(":")),
        float(span.count("::")),
        sum(c in "0123456789abcdefABCDEF" for c in span) / len(span),
        float(len(groups)),
        float(max(groups, default=0)),
        float(groups[-1]) if groups else 0.0,
        float(first[0]),
        float(first[1]),
        float(first[2]),
        float(digits[:2] or -1),
        float(digits[:4] or -1),
        float(len(signs)),
        float(sum(c in "()[]{}" for c in span)),
        float(len(re.findall(r"\bdot\b", span))),
        float(span[0] == "+"),
        float(span[:1].isdigit()),
        float(bool(before) and not before[-1].isspace()),
        float(bool(before) and before[-1].isalnum()),
        float(bool(after) and after[0].isalnum()),
        float(sum(cue in before for cue in CUES[kind])),
        float(sum(cue in after for cue in CUES[kind])),
        float(before[-3:].count("=") + before[-3:].count(":")),
        float(before[-3:].count('"') + before[-3:].count("'")),
        float(any(c.isupper() for c in span) and any(c.islower() for c in span)),
    ]


def _steps(exact: int) -> list[float]:
    """Every whole number from -1 to ``exact``, then eight steps for each doubling."""
    wide = {math.floor(exact * 2 ** (i / 8)) for i in range(8 * 24)}
    return [float(v) for v in sorted({*range(-1, exact), *wide})]


def finest_grids() -> list[list[float]]:
    """For each feature the values it is snapped down to, rising."""
    shares = [i / 64 for i in range(64 * 17)]
    grids = [_steps(256) for _ in range(N_FEATURES)]
    grids[0] = [float(i) for i in range(len(KINDS))]
    for place in (3, 10, 15):
        grids[place] = shares
    grids[8], grids[22], grids[23] = _steps(1024), _steps(100), _steps(10_000)
    return grids


def coarser(grids: list[list[float]]) -> list[list[float]]:
    """Every other value of each grid; the kind stays as it is."""
    return [grids[0], *(grid[::2] for grid in grids[1:])]


def snapped(row: list[float], grids: list[list[float]]) -> list[float]:
    return [grid[max(0, bisect.bisect_right(grid, v) - 1)] for v, grid in zip(row, grids)]


def extra_label(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a candidate that is not a base span is personal data, by a rule of its own: an IPv6 address, a
    spelt-out address with a known top-level domain, a card number of a known issuer with a right check digit,
    a phone number in a national form or after a word that names one, or a secret.

    A secret is a random looking mix of digits and letters, of any length, that is assigned or quoted.
    """
    span, digits = text[start:end], digits_of(text[start:end])
    before = text[max(0, start - CONTEXT) : start].lower()
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]} "))[-1].lower()
        marked = bool(re.search(r"[(\[{](?:at|dot)[)\]}]| dot ", span))
        return "@" not in span and (last in _TOP_LEVEL or marked and bool(_COUNTRY.fullmatch(last)))
    if kind == "ip":
        return ":" in span and valid_ip6(span)
    if kind == "card":
        return bool(_ISSUED.fullmatch(digits)) and luhn(digits)
    if kind == "phone":
        named = bool(re.search(r"\b(?:phone|call|tel|fax|mobile)\b[a-z .:]{0,12}$", before)) and 7 <= len(digits) <= 15
        return named or bool(_NATIONAL.fullmatch(span)) and not text[max(0, start - 1) : start].isalnum()
    mixed = sum(c.isdigit() for c in span) >= 6 and sum(c.isalpha() for c in span) >= 6
    return mixed and bool(re.search(r"[=:\"'] ?[\"']?$", text[max(0, start - 3) : start]))


def valid_ip6(span: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(span)) and any(c.isdigit() for c in span) and len(span) > 4
    except ValueError:
        return False


def rule_label(text: str, kind: str, start: int, end: int) -> int:
    """The label that the trees learn from: the base rule for kinds that have one, or the rule for extra spans."""
    span = text[start:end]
    base = kind in BASE_KINDS and (0, len(span)) in base_spans(span)[kind]
    return int(base or extra_label(text, kind, start, end))


@dataclass
class Tree:
    """A regression tree as flat lists: ``feature`` is -1 at a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def grow(self, rows: np.ndarray, values: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int) -> int:
        """Adds the subtree of these rows, given as places in the rising ``values`` of each feature: the split with the
        largest gain of second order, or a leaf."""
        node = len(self.feature)
        self.feature.append(-1)
        self.cut.append(0.0)
        self.left.append(0)
        self.right.append(0)
        self.value.append(float(gradient.sum() / (hessian.sum() + 1.0)))
        best = (1e-6, -1, 0.0)
        for f in range(rows.shape[1] if depth else 0):
            size = len(values[f])
            there = np.flatnonzero(np.bincount(rows[:, f], minlength=size))
            g = np.cumsum(np.bincount(rows[:, f], gradient, size)[there])
            h = np.cumsum(np.bincount(rows[:, f], hessian, size)[there])
            gain = (g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1))[:-1]
            if len(gain) and gain.max() > best[0]:
                at = int(gain.argmax())
                best = (float(gain[at]), f, float((values[f][there[at]] + values[f][there[at + 1]]) / 2))
        if best[1] >= 0:
            side = values[best[1]][rows[:, best[1]]] <= best[2]
            self.feature[node], self.cut[node] = best[1], best[2]
            self.left[node] = self.grow(rows[side], values, gradient[side], hessian[side], depth - 1)
            self.right[node] = self.grow(rows[~side], values, gradient[~side], hessian[~side], depth - 1)
        return node

    def apply_all(self, rows: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        node = np.zeros(len(rows), int)
        while (inner := feature[node] >= 0).any():
            low = rows[np.arange(len(rows)), feature[node]] <= cut[node]
            node = np.where(inner, np.where(low, left[node], right[node]), node)
        return np.array(self.value)[node]

    def apply(self, row: list[float]) -> float:
        node = 0
        while self.feature[node] >= 0:
            node = self.left[node] if row[self.feature[node]] <= self.cut[node] else self.right[node]
        return self.value[node]


@dataclass
class Boosting:
    """Boosted trees for the logistic loss with a threshold per kind; ``grids`` are what its features are snapped to."""

    trees: list[Tree]
    start: float
    rate: float
    thresholds: dict[str, float]
    grids: list[list[float]] | None = None

    def probability(self, row: list[float]) -> float:
        row = snapped(row, self.grids) if self.grids else row
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.start + self.rate * sum(t.apply(row) for t in self.trees)))))


def boost(
    rows: np.ndarray, labels: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.3, counts: np.ndarray | None = None
) -> Boosting:
    """Trees for rows that stand for ``counts`` candidates each, or for one."""
    counts = np.ones(len(rows)) if counts is None else counts
    share = float(np.clip((labels * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
    start = math.log(share / (1 - share))
    ranked = [np.unique(column, return_inverse=True) for column in rows.T]
    values, places = [v for v, _ in ranked], np.column_stack([at.reshape(-1) for _, at in ranked])
    total, trees = np.full(len(rows), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = Tree()
        tree.grow(places, values, counts * (labels - p), counts * p * (1 - p), depth)
        trees.append(tree)
        total = total + rate * tree.apply_all(rows)
    return Boosting(trees, start, rate, {})


def calibrate(
    model: Boosting, kinds: list[str], scores: np.ndarray, labels: np.ndarray, precision: float = PRECISION, counts: np.ndarray | None = None
) -> None:
    """Per kind the lowest threshold that keeps the precision among all held-out candidates above it; a kind
    without such a threshold adds nothing. ``counts`` as in ``boost``."""
    counts = np.ones(len(scores)) if counts is None else counts
    for kind in KINDS:
        own = np.array([k == kind for k in kinds], bool)
        model.thresholds[kind] = 2.0
        order = np.argsort(-scores[own], kind="stable")
        ranked, hits = scores[own][order], np.cumsum((labels * counts)[own][order])
        good = hits / np.cumsum(counts[own][order]) >= precision
        last_of_tie = np.append(ranked[1:] != ranked[:-1], True)[: len(ranked)]
        if (good & last_of_tie).any():
            model.thresholds[kind] = float(ranked[np.flatnonzero(good & last_of_tie)[-1]])


_COUNTED = "checks boolean, label int, places binary"


def _counted(rows: DataFrame) -> DataFrame:
    """Equal rows of ``checks, label, places`` as one with their number ``n``."""
    n = F.sum("n") if "n" in rows.columns else F.count("*")
    return stage(rows.groupBy("checks", "label", "places").agg(n.cast("long").alias("n")), "candidates")


def counted_candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``checks, label, places, n``: all candidates of all documents, counted by their label and the places of their
    features in the finest grids (two bytes each). ``checks`` marks a third of the documents, by a fixed hash of the key."""
    likely = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    marked = likely.select("text", (F.pmod(F.xxhash64("key"), F.lit(3)) == 0).alias("checks"))

    def transform():
        grids = finest_grids()

        def places(row: list[float]) -> bytes:
            return np.array([max(0, bisect.bisect_right(g, v) - 1) for v, g in zip(row, grids)], np.uint16).tobytes()

        def step(batch: pa.RecordBatch) -> list:
            checks, labels, rows = [], [], []
            for body, check in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, s, e in candidates(body):
                    checks.append(bool(check))
                    labels.append(rule_label(body, k, s, e))
                    rows.append(places(features(body, k, s, e)))
            return [checks, labels, rows]

        return step

    return _counted(map_batches(marked, transform, _COUNTED))


def _halved(counted: DataFrame) -> DataFrame:
    """Counted candidates on grids of every other value."""

    def transform():
        def step(batch: pa.RecordBatch) -> list:
            places = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, N_FEATURES).copy()
            places[:, 1:] >>= 1
            return [batch.column(0), batch.column(1), [row.tobytes() for row in places], batch.column(3)]

        return step

    return _counted(map_batches(counted, transform, f"{_COUNTED}, n long"))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS) -> Boosting:
    """Trees and thresholds from every candidate in every document.

    Candidates are counted by label and snapped features; the trees are grown and the thresholds set with these counts, so
    none is left out. While there are more than ``rows`` different ones, the grids are halved, so the
    driver gets a bounded table of numbers. Two thirds train, the others set the thresholds.
    """
    grids, counted = finest_grids(), counted_candidates(docs, key, text)
    while counted.count() > rows and max(map(len, grids[1:])) > 1:
        grids, counted = coarser(grids), _halved(counted)
    given = sorted(counted.collect(), key=lambda r: (r["checks"], r["label"], bytes(r["places"])))
    fit, held = ([r for r in given if bool(r["checks"]) == side] for side in (False, True))
    if not fit or not held:
        return Boosting([], -30.0, 0.0, {})

    def table(given: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = np.frombuffer(b"".join(bytes(r["places"]) for r in given), np.uint16).reshape(-1, N_FEATURES)
        values = np.column_stack([np.array(grid)[places[:, f]] for f, grid in enumerate(grids)])
        return values, np.array([r["label"] for r in given], float), np.array([r["n"] for r in given], float)

    values, labels, counts = table(fit)
    model = boost(values, labels, counts=counts)
    model.grids = grids
    values, labels, counts = table(held)
    scores = np.array([model.probability(row) for row in values.tolist()])
    calibrate(model, [KINDS[int(kind)] for kind in values[:, 0]], scores, labels, counts=counts)
    return model


def spans_of(text: str | None, model: Boosting) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, float]]]:
    """Base spans, and all redacted spans with their probability (1 for base spans).

    Base spans always stay. Other candidates at or above their kind's threshold are added, the likeliest
    first (then longer, earlier, in the order of kinds), as long as they overlap no span that is already in.
    """
    if not text:
        return {kind: [] for kind in BASE_KINDS}, []
    base = base_spans(text)
    taken = [(kind, s, e, 1.0) for kind, spans in base.items() for s, e in spans]
    known = {(k, s, e) for k, s, e, _ in taken}
    scored = []
    for kind, s, e in candidates(text):
        if (kind, s, e) not in known and (limit := model.thresholds.get(kind, 2.0)) <= 1:
            p = model.probability(features(text, kind, s, e))
            if p >= limit:
                scored.append((p, kind, s, e))
    used = sorted((s, e) for _, s, e, _ in taken)
    for p, kind, s, e in sorted(scored, key=lambda c: (-c[0], c[2] - c[3], c[2], KINDS.index(c[1]))):
        at = bisect.bisect_left(used, (e, 0))
        if not any(b > s for _, b in used[max(0, at - 8) : at]):
            bisect.insort(used, (s, e))
            taken.append((kind, s, e, p))
    return base, sorted(taken, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


def find(docs: DataFrame, model: Boosting, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans, base`` of every row: spans ``kind, start, end, probability`` in code points, end exclusive,
    by kind and start; ``base`` says which of them come from the base rules.

    Whole texts are read; null and empty texts have no spans. Repeated keys stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def transform():
        model = shared.value

        def step(batch: pa.RecordBatch) -> list:
            rows = []
            for body in batch.column(1).to_pylist():
                base, spans = spans_of(body, model)
                own = {(k, s, e) for k, found in base.items() for s, e in found}
                rows.append([{"kind": k, "start": s, "end": e, "probability": p, "base": (k, s, e) in own} for k, s, e, p in spans])
            return [batch.column(0), rows]

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, spans array<struct<kind:string,start:long,end:long,probability:double,base:boolean>>"
    return map_batches(docs.select(F.col(key), F.col(text).cast("string")), transform, schema)


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """A text with every span replaced by its kind in angle brackets; overlapping spans become one, named after
    the first of them."""
    parts, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, model: Boosting, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``find`` replaced by its kind in angle brackets.

    Spans are found and replaced in one pass, row by row, so null and repeated keys are redacted like all
    others. A null text stays null; all other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def transform():
        model = shared.value

        def step(batch: pa.RecordBatch) -> list:
            texts = [t and redacted(t, spans_of(t, model)[1]) for t in batch.column(place).to_pylist()]
            return [texts if i == place else column for i, column in enumerate(batch.columns)]

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, transform, fields)


def listed(spans: str, base_only: bool = False):
    """Spans as kind:start:end, comma-joined."""
    kept = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
