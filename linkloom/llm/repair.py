"""Repair of conversations whose turns are lost, doubled, cut or given to the wrong speaker.

A repaired conversation reads ``(s?(ua)+)?`` by the first letters of its roles: an optional system turn, then
pairs of user and assistant. Of all edits that lead there the cheapest are taken, and of equally cheap ones
those whose letters come first in ASCII order:

====== ============================================= ====
letter edit                                          cost
====== ============================================= ====
K      keep the row                                  0
R      give the row to the user or the assistant     3
D      delete the row                                4
I      insert an empty user or assistant row         3
====== ============================================= ====

A row kept or given another role although its text is cut off costs 3 more; blank and repeated rows must go.

Two streams over rows that are dealt by conversation and sorted by turn do the work. The first has no texts:
it reads a conversation from its last row to its first, carries the costs to the end from each of four states
across Arrow batches, and notes per row in two bytes which edit each state takes. These notes go to a file of
the task once a conversation has many of them; read backwards they give the edits in order. The second stream
carries the texts and meets the edits of a conversation before its rows, so neither holds more than a batch,
the notes below the limit, and the string of edits, which is a part of the result.

The rows of one conversation are read by one task, since its edits, and a digest of its text, follow one another;
a giant conversation lengthens that task but not its memory.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notes of one conversation kept in memory, in bytes; beyond them they are spilled to a file of the task.
SPILL_BYTES = 4 << 20
#: Notes read back, and edits put together, at a time.
BLOCK = 1 << 20

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
EDITS = "DIKR"

# States: nothing kept, after a system row, after a user row, after an assistant row.
_AFTER = {"s": 1, "u": 2, "a": 3}
#: State after a user or assistant row that is inserted or given its role, whichever the state calls for.
_NEXT = (2, 2, 3, 2)
#: State after a kept row, by its letter; a letter that is missing cannot be kept there.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Cost of ending in a state: what is missing is inserted.
_END = (0, 6, 3, 0)
_ROLE = {2: "user", 3: "assistant"}
_LETTERS = "sua-"

PLAN = (
    "conv_id string, n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string"
)


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" "))


def _rows(rows: DataFrame) -> DataFrame:
    """The columns the repair reads; nulls in role and text are one space, a null turn comes first."""
    text, role = _or_space("text"), _or_space("role")
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """Every row without its text: ``blank``, ``cut`` and ``later``, whether an equal row stands at an earlier turn.

    Equal rows are found by aggregates over digests of the texts, so a row that a conversation repeats without
    end is folded before it is shuffled; only the rows that occur more than once are joined back.
    """
    last = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    place = F.struct(F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("turn"))
    narrow = _rows(rows).select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"), place.alias("place"),
    )
    key = ["conv_id", "role", "digest"]
    again = narrow.groupBy(*key).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(*[F.col(k).alias(f"_{k}") for k in key], "first")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    later = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return narrow.join(again, same, "left").select("conv_id", "turn", "role", "digest", "blank", "cut", later.alias("later"))


class _Steps:
    """The step of the cost table before a row, remembered: few different tables and kinds of rows exist."""

    def __init__(self):
        self.seen: dict[tuple, tuple] = {}

    def __call__(self, ahead: tuple[int, ...], letter: str, gone: bool, cut: bool) -> tuple[tuple[int, ...], int, int]:
        """Costs from the row on less their minimum, that minimum, and the edits of the four states in a byte."""
        key = (ahead, letter, gone, cut)
        if key not in self.seen:
            self.seen[key] = self._work_out(*key)
        return self.seen[key]

    @staticmethod
    def _work_out(ahead, letter, gone, cut):
        kept = [None if gone or letter not in k else (TRUNCATED if cut else 0) + KEEP + ahead[k[letter]] for k in _KEPT]
        given = [None if gone else (TRUNCATED if cut else 0) + REROLE + ahead[n] for n in _NEXT]
        costs = [min(c for c in (DELETE + ahead[q], kept[q], given[q]) if c is not None) for q in range(4)]
        for _ in range(3):  # no cheapest repair inserts more rows in one place
            costs = [min(costs[q], INSERT + costs[_NEXT[q]]) for q in range(4)]
        edits = 0
        for q in range(4):
            options = (DELETE + ahead[q], INSERT + costs[_NEXT[q]], kept[q], given[q])
            edits |= options.index(costs[q]) << 2 * q
        low = min(costs)
        return tuple(c - low for c in costs), low, edits


class _Conversation:
    """What is known of a conversation after its rows from the last down to some row."""

    def __init__(self, conv_id, steps: _Steps):
        self.conv_id, self.steps = conv_id, steps
        self.ahead, self.cost = _END, 0
        self.notes = tempfile.SpooledTemporaryFile(max_size=SPILL_BYTES)
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.letter = None

    def add(self, turn, role: str, blank: bool, duplicate: bool, cut: bool) -> None:
        letter = role[:1]
        self.rows += 1
        gone = blank or duplicate
        cut = cut and not gone
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += cut
        if self.letter is not None:
            self.illegal += letter + self.letter not in ("su", "ua", "au")
        self.letter = letter
        if turn is not None and turn != self.first_turn:
            self.turns += 1
            self.first_turn = turn
            self.last_turn = turn if self.last_turn is None else self.last_turn
        letter = letter if letter in _AFTER else "-"
        self.ahead, low, edits = self.steps(self.ahead, letter, gone, cut)
        self.cost += low
        self.notes.write(bytes((_LETTERS.index(letter), edits)))

    def plan(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        cost = self.cost + self.ahead[0]
        return (
            self.conv_id, self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self._audit()
        )

    def _audit(self) -> str:
        """The edits in order: the notes were written from the last row to the first and are read backwards."""
        state, parts, left = 0, [], self.notes.tell()
        while left:
            size = min(BLOCK, left)
            self.notes.seek(left - size)
            block = self.notes.read(size)
            left -= size
            part = bytearray()
            for at in range(size - 1, 0, -2):
                while True:
                    edit = block[at] >> 2 * state & 3
                    part.append(ord(EDITS[edit]))
                    if edit == 2:
                        state = _KEPT[state][_LETTERS[block[at - 1]]]
                    elif edit:
                        state = _NEXT[state]
                    if edit != 1:
                        break
            parts.append(part.decode("ascii"))
        self.notes.close()
        return "".join(parts) + "I" * (_END[state] // INSERT)


def _by_conversation(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows dealt by conversation and sorted; whole numbers go to Python as text, since pandas makes floats of nulls."""
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)
    return dealt.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})


def _values(batch: pd.DataFrame) -> Iterator[tuple]:
    """The rows of a batch with None for what is null."""
    turns = [None if t is None else int(t) for t in batch["turn"]]
    return zip(*(turns if name == "turn" else column for name, column in batch.items()))


def _typed(found: DataFrame, rows: DataFrame) -> DataFrame:
    return found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def plans(rows: DataFrame) -> DataFrame:
    """The faults of every conversation and its cheapest edits.

    ``rows(conv_id, turn, role, text)``, further columns are ignored. Rows are read by turn, null turns first, rows
    of one turn by role and digest of the text. Rows that are equal in all of that are repeats of each other. A
    null ``conv_id`` is a conversation of its own; a null role or text counts as one space; a row with an empty role or
    one of another first letter cannot be kept as it is. No rows give no rows.
    Returns ``conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit``; a row counts under its
    first fault, ``illegal`` counts neighbours that are not ``su``, ``ua`` or ``au``.
    """
    order = [F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc()]
    names = [c.split()[0] for c in PLAN.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, talk, held = _Steps(), None, None
        for batch in batches:
            done = []
            for conv_id, turn, role, digest, blank, cut, later in _values(batch):
                # A row is a repeat if the next one here, which stands before it, is equal: so it waits for that one.
                if held:
                    talk.add(*held[:2], held[3], held[5] or (talk.conv_id == conv_id and held[:3] == (turn, role, digest)), held[4])
                if talk is None or talk.conv_id != conv_id:
                    if talk:
                        done.append(talk.plan())
                    talk = _Conversation(conv_id, steps)
                held = (turn, role, digest, blank, cut, later)
            if done:
                yield pd.DataFrame(done, columns=names)
        if talk:
            talk.add(*held[:2], held[3], held[5], held[4])
            yield pd.DataFrame([talk.plan()], columns=names)

    return _typed(_by_conversation(faults(rows), *order).mapInPandas(stream, PLAN), rows)


def _walk(rows: DataFrame, planned: DataFrame, emit: Callable[[], object], schema: str) -> DataFrame:
    """Follows the edits of each conversation along its rows.

    ``emit()`` is made once per task; it has ``put(conv_id, turn, role, text, edit)`` for each repaired row,
    ``end(conv_id)``, and ``take()`` for the rows that are ready.
    """
    heads = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    bodies = _rows(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    both = heads.unionByName(bodies).withColumn("digest", F.when(F.col("kind") == 1, F.md5("text")))
    order = [F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    sorted_rows = _by_conversation(both, *order).drop("digest")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, talk, audit, at, state = emit(), None, "", 0, 0

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = _NEXT[state], at + 1
                out.put(talk, None, _ROLE[state], "", "I")

        for batch in batches:
            for conv_id, kind, turn, role, text in _values(batch):
                if kind == 0:
                    if talk is not None or at:
                        inserts()
                        out.end(talk)
                    talk, audit, at, state = conv_id, text, 0, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = _AFTER[role[0]]
                    out.put(conv_id, turn, role, text, edit)
                elif edit == "R":
                    state = _NEXT[state]
                    out.put(conv_id, turn, _ROLE[state], text, edit)
            ready = out.take()
            if len(ready):
                yield ready
        if talk is not None or at:
            inserts()
            out.end(talk)
            yield out.take()

    return _typed(sorted_rows.mapInPandas(stream, schema), rows)


class _Turns:
    def __init__(self):
        self.place, self.ready = 0, []

    def put(self, conv_id, turn, role, text, edit):
        self.ready.append((conv_id, self.place, None if turn is None else str(turn), role, text, edit))
        self.place += 1

    def end(self, conv_id):
        self.place = 0

    def take(self) -> pd.DataFrame:
        found, self.ready = self.ready, []
        return pd.DataFrame(found, columns=["conv_id", "place", "turn", "role", "text", "edit"])


class _Digests:
    def __init__(self):
        self.sha, self.first, self.ready = hashlib.sha256(), True, []

    def put(self, conv_id, turn, role, text, edit):
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def end(self, conv_id):
        self.ready.append((conv_id, self.sha.hexdigest()))
        self.sha, self.first = hashlib.sha256(), True

    def take(self) -> pd.DataFrame:
        found, self.ready = self.ready, []
        return pd.DataFrame(found, columns=["conv_id", "repaired_sha256"])


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows of every repaired conversation: ``conv_id, place, turn, role, text, edit``.

    ``place`` counts from 0; an inserted row has a null turn and an empty text. A conversation all of whose rows are
    deleted has no rows. ``planned`` is ``plans(rows)`` for the same rows.
    """
    found = _walk(rows, planned, _Turns, "conv_id string, place bigint, turn string, role string, text string, edit string")
    return found.withColumn("turn", F.col("turn").cast("bigint"))


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of each repaired conversation's ``role:text``, joined by newlines."""
    return _walk(rows, planned, _Digests, "conv_id string, repaired_sha256 string")
