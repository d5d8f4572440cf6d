"""Versioned Parquet tables.

A commit writes the new files of every changed table first and then one row of the commit log;
readers take the newest log row, so a crash in between leaves the old state in place. A table is
split into a fixed number of buckets by the hash of its key, and a commit may replace only the
buckets its rows fall into: the log keeps the version of each bucket. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BOOKMARK_SCHEMA, SYNC_STATE_SCHEMA, VECTOR_SCHEMA
from ..session import COMPRESSION


@dataclass(frozen=True)
class TableSpec:
    schema: T.StructType
    key: str
    buckets: int
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    # Lay the table out by range over ``sort_by`` instead of by bucket.
    ranged: bool = False
    # Columns with a Bloom filter per row group, for point reads.
    bloom: tuple[str, ...] = ()
    # The key is the number of the bucket itself.
    keyed_by_bucket: bool = False


POSTING_SCHEMA = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("lead", T.StringType()),
        T.StructField("block", T.IntegerType()),
    ]
)
BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("lead", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("max_freq", T.LongType()),
        T.StructField("min_length", T.IntegerType()),
    ]
)
ID_SCHEMA = T.StructType([T.StructField("id", T.StringType())])
LENGTH_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("length", T.IntegerType())])
# A vector in one byte per entry, see ``operators.quantised``.
CODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("error", T.DoubleType()),
        T.StructField("codes", T.BinaryType()),
    ]
)
ANSWER_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("input_hash", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)
PART_SCHEMA = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total_length", T.LongType())]
)
FETCH_SCHEMA = T.StructType(
    [
        T.StructField("feed", T.StringType()),
        T.StructField("fetched", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("upto", T.IntegerType()),
        T.StructField("mark", T.LongType()),
        T.StructField("newest", T.LongType()),
        T.StructField("what", T.StringType()),
    ]
)

DEFAULT_BUCKETS = 64

# Tasks that a bucket is written by at most.
BUCKET_TASKS = 256

# Where dealt rows lie: a bucket, and the task of it that writes a row. Both follow from the key.
DEALT = ("bucket", "_share")

# Marks the rows that take the place of stored rows with the same key.
NEWER = "_newer"

# Distinct values a Bloom filter is sized for; about the rows of one row group.
BLOOM_ROWS = 50_000


def default_tables(buckets: int = DEFAULT_BUCKETS) -> dict[str, TableSpec]:
    """Table layouts. Raise ``buckets`` with the data; some hundred MB per bucket is a good size."""
    return {
        "bookmarks": TableSpec(BOOKMARK_SCHEMA, "url", buckets, ("source",), ("id",), bloom=("id", "url")),
        "vectors": TableSpec(VECTOR_SCHEMA, "id", buckets, (), ("id",), bloom=("id",)),
        "vector_codes": TableSpec(CODE_SCHEMA, "id", buckets),
        "sync_state": TableSpec(SYNC_STATE_SCHEMA, "key", 1),
        "postings": TableSpec(POSTING_SCHEMA, "term", 1, ("lead",), ("lead", "term", "block"), ranged=True),
        "prefix_blocks": TableSpec(BLOCK_SCHEMA, "prefix", 1, ("lead",), ("lead", "prefix", "block"), ranged=True),
        "postings_recent": TableSpec(POSTING_SCHEMA, "id", buckets, (), ("term",)),
        "stale_ids": TableSpec(ID_SCHEMA, "id", buckets),
        "doc_lengths": TableSpec(LENGTH_SCHEMA, "id", buckets),
        # Model answers by the hash of what was asked.
        "answers": TableSpec(ANSWER_SCHEMA, "key", buckets, (), ("key",)),
        # What each run of the enrichment did to a row, and runs that are due (rows without an id).
        "enrich_log": TableSpec(LEDGER_SCHEMA, "id", buckets),
        "enrich_due": TableSpec(LEDGER_SCHEMA, "run", 1),
        # What each bucket of ``doc_lengths`` adds to the corpus statistics.
        "corpus_parts": TableSpec(PART_SCHEMA, "part", buckets, keyed_by_bucket=True),
        # Decisions on fetches that a stream has not merged yet.
        "fetch_log": TableSpec(FETCH_SCHEMA, "feed", 1),
    }


@dataclass
class Parts:
    """New contents of a table, or of some of its buckets, in two parts.

    ``kept`` comes from the table's own files and is written by the tasks that hold it, without a shuffle. ``dealt`` is
    shuffled to ``DEALT``; there ``made`` turns it into the rows to write, which keep these columns and their key.
    """

    kept: DataFrame | None = None
    dealt: DataFrame | None = None
    made: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Ranges:
    """New contents of a table laid out by range: each partition of ``rows`` holds a range of its own."""

    rows: DataFrame


@dataclass
class Written:
    """Contents of a table that are written and wait for their commit."""

    version: int
    buckets: list[int]
    rows: DataFrame


_LOG_SCHEMA = "version bigint, batch_id string, layout string"


# Entry of a log row's layout that holds the bucket counts.
_BUCKETS = "#buckets"


@dataclass
class Snapshot:
    version: int = 0
    layout: dict[str, dict[str, int]] = field(default_factory=dict)
    # Bucket counts the tables were written with; they outrank the counts of the specs.
    buckets: dict[str, int] = field(default_factory=dict)


class TableStore:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, TableSpec] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.tables = tables or default_tables()

    def _log(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(_LOG_SCHEMA).json(f"{self.root}/log")

    def snapshot(self) -> Snapshot:
        log = self._log()
        row = None if log is None else log.orderBy(F.col("version").desc()).select("version", "layout").first()
        if not row:
            return Snapshot()
        layout = json.loads(row.layout)
        buckets = layout.pop(_BUCKETS, {})
        return Snapshot(row.version, layout, buckets)

    def has_batch(self, batch_id: str) -> bool:
        log = self._log()
        return log is not None and bool(log.filter(F.col("batch_id") == batch_id).take(1))

    def empty(self, name: str) -> DataFrame:
        """No rows, in a form the optimizer sees as empty, so that joins with it vanish."""
        columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.tables[name].schema.fields]
        return self.spark.range(1).select(*columns).filter(F.lit(False))

    def bucket_of(self, name: str, key: Column | None = None) -> Column:
        spec = self.tables[name]
        key = F.col(spec.key) if key is None else key
        if spec.keyed_by_bucket:
            return key.cast("int")
        buckets = self.snapshot().buckets.get(name, spec.buckets)
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def slice_of(self, name: str, slices: int) -> Column:
        """Which of so many slices of about one size a row is in. A slice lies in as few buckets as it can."""
        spec = self.tables[name]
        buckets = self.snapshot().buckets.get(name, spec.buckets)
        place = self.bucket_of(name) + F.pmod(F.xxhash64(F.lit("slice"), F.col(spec.key)), F.lit(1 << 20)) / (1 << 20)
        return F.floor(place * slices / buckets).cast("int")

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """Buckets the rows of ``keys`` fall into; at most the bucket count of the table."""
        rows = keys.select(self.bucket_of(name).alias("bucket")).distinct().collect()
        return sorted(row.bucket for row in rows)

    def read(self, name: str, buckets: Iterable[int] | None = None, at: Snapshot | None = None) -> DataFrame:
        layout = (at or self.snapshot()).layout.get(name, {})
        wanted = None if buckets is None else {str(b) for b in buckets}
        return self._files(name, {b: v for b, v in layout.items() if wanted is None or b in wanted})

    def _files(self, name: str, layout: dict[str, int]) -> DataFrame:
        spec = self.tables[name]
        base = f"{self.root}/{name}"
        paths = [f"{base}/v={v}/bucket={b}" for b, v in sorted(layout.items())]
        if not paths:
            return self.empty(name)
        rows = self.spark.read.schema(spec.schema).option("basePath", base).parquet(*paths)
        return rows.select(*spec.schema.fieldNames())

    def commit(
        self,
        batch_id: str,
        changes: dict[str, DataFrame | Parts | Ranges | Written],
        touched: dict[str, list[int]] | None = None,
    ) -> int:
        """Publish new contents of the changed tables as one version and return it.

        ``touched`` limits the replacement of a table to some of its buckets; the DataFrame then
        holds the new contents of these buckets only. Unreplaced buckets and tables are kept. A batch
        id that was committed before changes nothing. Rows with a column ``_newer`` are merged while they are
        written: those of a key that are not newer go when it has newer ones.
        """
        before = self.snapshot()
        if self.has_batch(batch_id):
            return before.version
        version = before.version + 1
        layout = {name: dict(buckets) for name, buckets in before.layout.items()}
        for name, rows in changes.items():
            if isinstance(rows, Written):
                if rows.version != version:
                    raise RuntimeError(f"{name} was written for version {rows.version}, not {version}")
                written = rows.buckets
            else:
                written = self._write(name, rows, version)
            replaced = (touched or {}).get(name)
            kept = {} if replaced is None else {b: v for b, v in layout.get(name, {}).items() if int(b) not in replaced}
            layout[name] = kept | {str(b): version for b in written}
        buckets = {n: before.buckets.get(n, self.tables[n].buckets) for n in layout}
        row = [(version, batch_id, json.dumps(layout | {_BUCKETS: buckets}))]
        self.spark.createDataFrame(row, _LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{self.root}/log")
        return version

    def prepare(self, name: str, rows: DataFrame | Parts) -> Written:
        """Writes what the next commit is to publish of a table, so that the other changes of that commit can be made from
        what was written. Nothing of it is visible before; there is no other commit in between."""
        version = self.snapshot().version + 1
        buckets = self._write(name, rows, version)
        return Written(version, buckets, self._files(name, {str(b): version for b in buckets}))

    def deal(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` with ``DEALT``, shuffled there."""
        # A bucket of a large table is written by several tasks, a file each; small ones are put together again.
        share = F.pmod(F.xxhash64(F.lit("file"), F.col(self.tables[name].key)), F.lit(BUCKET_TASKS))
        return rows.withColumns(dict(zip(DEALT, (self.bucket_of(name), share)))).repartition(*DEALT)

    def _laid(self, name: str, parts: Parts) -> DataFrame:
        spec, found = self.tables[name], []
        names = spec.schema.fieldNames()
        if parts.kept is not None:
            found.append(parts.kept.select(*names).withColumn("bucket", self.bucket_of(name)))
        if parts.dealt is not None:
            dealt = self.deal(name, parts.dealt)
            if parts.made:
                dealt = parts.made(dealt)
            elif NEWER in dealt.columns:  # the rows of a key are already together
                newest = Window.partitionBy(*DEALT, spec.key).orderBy(F.col(NEWER).desc())
                dealt = dealt.withColumn("_place", F.rank().over(newest)).filter("_place = 1")
            found.append(dealt.select(*names, "bucket"))
        return reduce(DataFrame.union, found)

    def _write(self, name: str, rows: DataFrame | Parts | Ranges, version: int) -> list[int]:
        spec = self.tables[name]
        # A version left behind by a crash has no log row; its files are simply replaced.
        path = target = f"{self.root}/{name}/v={version}"
        folders = ("bucket", *spec.partition_by)
        if spec.ranged:
            # The only bucket is part of the path: as a constant column it would drop out of the sort below, and the
            # writer would then sort by folder alone.
            target, folders = f"{path}/bucket=0", spec.partition_by
            laid = rows.rows if isinstance(rows, Ranges) else rows.repartitionByRange(*spec.sort_by)
            laid = laid.select(*spec.schema.fieldNames())
        else:
            laid = self._laid(name, rows if isinstance(rows, Parts) else Parts(dealt=rows))
        if spec.sort_by:
            laid = laid.sortWithinPartitions(*folders, *[c for c in spec.sort_by if c not in folders])
        writer = laid.write.mode("overwrite").option("compression", COMPRESSION).partitionBy(*folders)
        for column in spec.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_ROWS))
        writer.parquet(target)
        schema = T.StructType([*spec.schema.fields, T.StructField("bucket", T.IntegerType())])
        found = self.spark.read.schema(schema).parquet(path).select("bucket").distinct().collect()
        return sorted(row.bucket for row in found)
