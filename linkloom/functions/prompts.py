"""Prompt rendering and response parsing around a summary model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MODEL_BYTES, byte_cap, trim_ws

CONTENT_MARK = "Page text:\n"

DEFAULT_PROMPT = (
    "Describe the page below in one or two sentences that would help somebody find it again, "
    "and name three to five keywords.\n"
    "Answer in two lines, starting with SUMMARY: and KEYWORDS: (comma separated).\n\n"
    + CONTENT_MARK
    + "%s"
)


#: Page text in a prompt for models that take short prompts only.
PROMPT_BYTES = MODEL_BYTES


def render_prompt(content: Column, template: str | None = None, limit: int | None = None) -> Column:
    """The template with its ``%s`` replaced by the content, cut to ``limit`` bytes if there is one."""
    template = template or DEFAULT_PROMPT
    if template.count("%s") != 1:
        raise ValueError("a prompt template needs exactly one %s")
    head, tail = template.split("%s")
    return F.concat(F.lit(head), content if limit is None else byte_cap(content, limit), F.lit(tail))


def _last_line(lines: Column, label: str) -> Column:
    hits = F.filter(lines, lambda line: line.startswith(label))
    value = F.try_element_at(hits, F.lit(-1))
    return F.coalesce(trim_ws(F.substring(value, len(label) + 1, 1 << 30)), F.lit(""))


def parse_response(response: Column) -> Column:
    """Struct of summary, keywords and the raw response; the last line of a kind wins."""
    lines = F.transform(F.split(response, "\n"), trim_ws)
    return F.struct(
        _last_line(lines, "SUMMARY:").alias("summary"),
        _last_line(lines, "KEYWORDS:").alias("keywords"),
        response.alias("raw_response"),
    )
