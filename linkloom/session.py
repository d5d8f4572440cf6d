"""Session settings and the shared folder for data that must survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Input of one step in a Python worker, on average: what a step holds at once is a multiple of it.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Codec of the Parquet files of stages and stored tables.
COMPRESSION = "zstd"


def build_session(master: str | None = None, app: str = "linkloom", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on. Partition counts are left to AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Push whole id lists of a result page to the scan, not just their range.
        "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may fall back to a folder of its own; on a cluster a machine-local
    folder would vanish with its machine, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="linkloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/linkloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several outputs and must not be computed twice (model calls), or
    where lineage has to be cut in a way that survives the loss of executors. Texts are most of what is
    written, so the files are packed tighter than Spark does it by default.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=COMPRESSION)
    return spark.read.schema(df.schema).parquet(path)


def observed(seen: Observation, names: list[str]) -> dict[str, int]:
    """The counters of an observed DataFrame whose job has ended.

    The optimizer cuts a part of a plan that turns out to have no rows, and its counters with it; they are 0.
    """
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return dict.fromkeys(names, 0)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` cut finer when their scan has fewer splits than the cluster has task slots.

    A few files that cannot be split would leave most cores idle during costly text work. A large
    table has more splits than slots and is read as it lies, without a shuffle.
    """
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= slots else rows.repartition(slots, *keys)


def bound_batches(spark: SparkSession) -> None:
    """Limits Arrow batches in bytes on their way to Python workers; a limit given with a unit is somebody's choice."""
    limit = spark.conf.get(BATCH_SETTING).rstrip("b")
    if limit.isdigit() and int(limit) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def timestamp(value: str | Column) -> Column:
    """``value`` as a timestamp; times enter every job as arguments so that results repeat."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")
