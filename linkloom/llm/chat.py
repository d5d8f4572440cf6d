"""Chat formatting: layouts told apart by a hash of their field paths, one template, a reversible escape."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How records with a certain set of field paths become turns.

    ``rows``: one turn per row, as (conversation, position, role, text) columns. ``messages``: a list, as
    (list, role field, text field). ``fields``: (role, path) in the order of the turns; blank optional
    ones are left out. A path into a list is written ``list[].field``.
    """

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()


def _messages(name: str, many: str, role: str, text: str, *more: str) -> Layout:
    return Layout(name, (f"{many}[].{role}", f"{many}[].{text}", *more), messages=(many, role, text))


def _fields(name: str, *fields: tuple[str, str]) -> Layout:
    return Layout(name, tuple(path for _, path in fields), fields=fields)


#: Layouts in use; records of any other layout are kept apart, never guessed.
LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    _messages("messages", "messages", "role", "content"),
    _messages("turns", "turns", "role", "text"),
    _messages("conversations", "conversations", "from", "value"),
    _fields("prompt and completion", ("user", "prompt"), ("assistant", "completion")),
    _fields("prompt and response", ("user", "prompt"), ("assistant", "response")),
    _fields("question and answer", ("user", "question"), ("assistant", "answer")),
    _fields("instruction", ("user", "instruction"), ("assistant", "output")),
    _fields("instruction with input", ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    _fields("system and prompt", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
)
#: Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: Iterator[str] | tuple[str, ...]) -> str:
    """SHA-256 of the sorted field paths, one per line."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(schema: T.DataType, prefix: str = "") -> Iterator[str]:
    """Paths of all fields that hold values; a list adds ``[]``."""
    if isinstance(schema, T.StructType):
        for field in schema:
            yield from schema_paths(field.dataType, f"{prefix}.{field.name}" if prefix else field.name)
    elif isinstance(schema, T.ArrayType):
        yield from schema_paths(schema.elementType, f"{prefix}[]")
    else:
        yield prefix


def _role(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(named, role), role, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_role(role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def by_schema(records: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``key, layout, turns`` of a table whose schema has one of the layouts.

    The fingerprint of the schema's field paths (without ``key``, unless the layout is one of turn rows,
    and without the columns in ``ignore``) selects the layout; a schema that fits none is an error. Null
    texts and roles become empty. Turns of one position are ordered by role and text; rows without a
    position come first and rows without a key are one conversation.
    """
    paths = [p for p in schema_paths(records.schema) if p not in ignore]
    known = {fingerprint(layout.paths): layout for layout in layouts}
    layout = known.get(fingerprint(paths)) or known.get(fingerprint([p for p in paths if p != key]))
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(paths)}")
    if layout.rows:
        conversation, position, role, text = layout.rows
        turn = F.struct(F.col(position).alias("at"), _turn(F.col(role), F.col(text)).alias("turn"))
        packed = records.groupBy(F.col(conversation).alias(key)).agg(F.array_sort(F.collect_list(turn)).alias("t"))
        return packed.select(key, F.lit(layout.name).alias("layout"), F.col("t.turn").alias("turns"))
    return records.select(key, F.lit(layout.name).alias("layout"), _struct_turns(layout).alias("turns"))


def _struct_turns(layout: Layout) -> Column:
    if layout.messages:
        many, role, text = layout.messages
        found = F.filter(F.col(many), lambda m: m.isNotNull())
        return F.coalesce(F.transform(found, lambda m: _turn(m[role], m[text])), F.array().cast(TURNS))
    return _field_turns([(role, F.col(path)) for role, path in layout.fields])


def _field_turns(fields: list[tuple[str, Column]]) -> Column:
    """Turns of single fields; fields of one role that follow each other are joined by an empty line."""
    merged: list[tuple[str, list[Column]]] = []
    for role, column in fields:
        if merged and merged[-1][0] == role:
            merged[-1][1].append(column)
        else:
            merged.append((role, [column]))
    turns = [
        _turn(F.lit(role), F.concat_ws("\n\n", *[F.when(c != "", c) for c in columns]) if len(columns) > 1 else columns[0])
        for role, columns in merged
    ]
    return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (t["text"] != ""))


def record_paths(record: str = "record") -> Column:
    """The field paths of a JSON record as its variant's schema without value types."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(shape, r"\b(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\s*\d+\)|FLOAT|DATE|TIMESTAMP\w*)(?=[,>]|$)", "_")


def layout_shape(layout: Layout) -> str:
    """What ``record_paths`` gives for a record of a layout."""
    if layout.messages:
        many, role, text = layout.messages
        inner = ", ".join(f"{name}: _" for name in sorted((role, text)))
        return f"OBJECT<{many}: ARRAY<OBJECT<{inner}>>>"
    return "OBJECT<" + ", ".join(f"{name}: _" for name in sorted(layout.paths)) + ">"


def by_record(records: DataFrame, key: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``key, layout, turns`` of JSON records whose layouts differ from row to row.

    Every record's own fingerprint selects its layout. Null, broken and unknown records have a null layout
    and no turns, so that they can be counted and kept apart. Row functions only; nothing is shuffled.
    """
    value = F.try_parse_json(record)
    name = F.lit(None).cast("string")
    turns = F.array().cast(TURNS)
    own = F.sha2(record_paths(record), 256)
    for layout in layouts:
        if not layout.rows:
            fits = own == hashlib.sha256(layout_shape(layout).encode()).hexdigest()
            name = F.when(fits, layout.name).otherwise(name)
            turns = F.when(fits, _variant_turns(value, layout)).otherwise(turns)
    return records.select(key, name.alias("layout"), turns.alias("turns"))


def _variant_turns(value: Column, layout: Layout) -> Column:
    if layout.messages:
        many, role, text = layout.messages
        found = F.try_variant_get(value, f"$.{many}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.coalesce(F.transform(found, lambda m: _turn(m[role], m[text])), F.array().cast(TURNS))
    return _field_turns([(role, F.try_variant_get(value, f"$.{path}", "string")) for role, path in layout.fields])


@dataclass(frozen=True)
class Template:
    """Marks around roles and texts. ``controls`` are the strings that must not occur in a text as they are.

    The escape doubles every backslash and puts a backslash and a dot behind the first character of each
    control string, so reading left to right gives the text back.
    """

    before_role: str = "<s>[INST] "
    before_text: str = " [/INST]\n"
    after_text: str = "</s>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    answers: str = "assistant"

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for control in self.controls:
            text = text.replace(control, f"{control[0]}\\.{control[1:]}")
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\)|\\\.", lambda m: m[1] or "", text)

    def write(self, turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and the spans (code points) of the answers in it: the loss mask."""
        parts, spans, at = [], [], 0
        for turn in turns:
            head = self.before_role + self.escape(turn["role"]) + self.before_text
            body = self.escape(turn["text"])
            at += len(head)
            if turn["role"] == self.answers:
                spans.append((at, at + len(body)))
            at += len(body) + len(self.after_text)
            parts += [head, body, self.after_text]
        return "".join(parts), spans

    def read(self, formatted: str) -> list[dict]:
        """The turns of a formatted conversation."""
        turns = []
        for piece in formatted.split(self.after_text)[:-1]:
            role, _, text = piece.removeprefix(self.before_role).partition(self.before_text)
            turns.append({"role": self.unescape(role), "text": self.unescape(text)})
        return turns

    def masked(self, formatted: str, spans: list[tuple[int, int]]) -> list[str]:
        """The texts under the loss mask."""
        return [self.unescape(formatted[start:end]) for start, end in spans]


def format_turns(conversations: DataFrame, key: str = "conv_id", template: Template = Template()) -> DataFrame:
    """``key, formatted, loss_mask`` from ``key, turns``; the mask lists spans ``start, end`` in code points.

    Null turns count as none and give an empty text; null roles and texts as empty ones.
    """

    def transform():
        def step(batch: pa.RecordBatch) -> list:
            clean = [[{n: t[n] or "" for n in ("role", "text")} for t in turns or [] if t] for turns in batch.column(1).to_pylist()]
            made = [template.write(turns) for turns in clean]
            return [batch.column(0), [m[0] for m in made], [[{"start": a, "end": b} for a, b in m[1]] for m in made]]

        return step

    kind = conversations.schema[key].dataType.simpleString()
    return map_batches(conversations.select(key, "turns"), transform, f"`{key}` {kind}, formatted string, loss_mask array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame, key: str = "conv_id", template: Template = Template()) -> DataFrame:
    """``key, turns, answers``: the turns of each formatted text and the texts under its loss mask."""

    def transform():
        def step(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            masks = [[(m["start"], m["end"]) for m in mask or []] for mask in batch.column(2).to_pylist()]
            return [batch.column(0), [template.read(t) for t in texts], [template.masked(t, m) for t, m in zip(texts, masks)]]

        return step

    kind = formatted.schema[key].dataType.simpleString()
    return map_batches(formatted.select(key, "formatted", "loss_mask"), transform, f"`{key}` {kind}, turns {TURNS}, answers array<string>")
