"""Landed feed pages: one text file per page, or rows of ``(feed, page_no, body)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FETCHED_PAGE_SCHEMA, PAGE_SCHEMA

_FILE_SCHEMA = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("feed", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
    ]
)


def read_page_files(spark: SparkSession, root: str) -> DataFrame:
    """Whole files below ``root/feed=<name>/page_no=<n>/``; both folders prune the listing."""
    files = spark.read.schema(_FILE_SCHEMA).text(root, wholetext=True)
    return files.select("feed", "page_no", F.col("value").alias("body"))


def read_page_rows(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Pages packed many to a file (JSON lines or Parquet), the layout for large imports."""
    return spark.read.format(fmt).schema(PAGE_SCHEMA).load(path)


def stream_page_files(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    files = (
        spark.readStream.schema(_FILE_SCHEMA)
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(root)
    )
    return files.select("feed", "page_no", F.col("value").alias("body"))


def stream_page_rows(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


@dataclass
class FetchedPages:
    """Landed rows of ``(feed, page_no, body, fetched_at)``, to be streamed and to be read again."""

    spark: SparkSession
    path: str
    fmt: str = "json"
    files_per_batch: int = 1000

    def stream(self) -> DataFrame:
        reader = self.spark.readStream.format(self.fmt).schema(FETCHED_PAGE_SCHEMA)
        return reader.option("maxFilesPerTrigger", self.files_per_batch).load(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.format(self.fmt).schema(FETCHED_PAGE_SCHEMA).load(self.path)
