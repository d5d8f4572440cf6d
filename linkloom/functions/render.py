"""Display forms of bookmark rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import sanitize_line, snippet

# The label shown for each source.
SOURCE_LABELS = {"x": "[X]", "raindrop": "[R]", "github": "[G]", "manual": "[M]"}
UNKNOWN_LABEL = "[?]"

CLI_SUMMARY_BYTES = 100
LIST_SUMMARY_BYTES = 80
DELETE_TITLE_BYTES = 50


def source_label(source: Column) -> Column:
    label = F
    for name, text in SOURCE_LABELS.items():
        label = label.when(source == name, text)
    return label.otherwise(UNKNOWN_LABEL)


def display_title(source: Column, title: Column) -> Column:
    return F.concat(source_label(source), F.lit(" "), sanitize_line(title))


def display_description(summary: Column, url: Column) -> Column:
    short = snippet(sanitize_line(summary), LIST_SUMMARY_BYTES)
    return F.when(F.coalesce(summary, F.lit("")) != "", short).otherwise(url)


def cli_summary(summary: Column) -> Column:
    return snippet(summary, CLI_SUMMARY_BYTES, CLI_SUMMARY_BYTES - 3)


def delete_prompt_title(title: Column) -> Column:
    return snippet(title, DELETE_TITLE_BYTES)


def result_json(columns: list[str]) -> Column:
    """One JSON object per row; blank text fields and missing times are left out."""
    optional = {"summary", "keywords", "notes", "raw_content"}
    fields = [
        (F.nullif(F.col(c), F.lit("")) if c in optional else F.col(c)).alias(c) for c in columns
    ]
    return F.to_json(F.struct(*fields))


def result_tsv() -> Column:
    """Source, title and url separated by tabs."""
    columns = [F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]+", " ") for c in ("source", "title", "url")]
    return F.concat_ws("\t", *columns)


def result_text(results: DataFrame, rank: str = "rank") -> DataFrame:
    """Numbered plain-text blocks, one row per result of an already cut ranking."""
    number = F.row_number().over(Window.orderBy(rank))
    return results.select(number.alias("n"), text_block(number).alias("line"))


def text_block(number: Column) -> Column:
    """A result as a numbered block of plain text."""
    return F.concat(
        F.format_string("%d. ", number),
        source_label(F.col("source")),
        F.lit(" "),
        F.coalesce("title", F.lit("")),
        F.lit("\n   "),
        F.col("url"),
        F.when(F.col("summary") != "", F.concat(F.lit("\n   "), cli_summary(F.col("summary")))).otherwise(""),
    )
