"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import result_json, result_text, result_tsv
from ..schema import BOOKMARK_COLUMNS


def json_lines(results: DataFrame) -> DataFrame:
    columns = [c for c in BOOKMARK_COLUMNS if c in results.columns]
    return results.select(result_json(columns).alias("value"))


def write_json(results: DataFrame, path: str) -> None:
    json_lines(results).write.text(path)


def write_tsv(results: DataFrame, path: str) -> None:
    results.select(result_tsv().alias("value")).write.text(path)


def write_text(results: DataFrame, path: str) -> None:
    result_text(results).orderBy("n").select(F.col("line").alias("value")).write.text(path)
