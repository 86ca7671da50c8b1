"""Session settings and small checks every operator relies on."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins on (attempt, digest) may reuse a layout bucketed or partitioned by attempt alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


#: Stateful streams keep their keys in RocksDB, which timers need and which is not held in heap.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


#: Folder of the ``passing`` block that this thread is in.
_PASSING: contextvars.ContextVar[str | None] = contextvars.ContextVar("passing", default=None)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for what starts inside the block; the session's own come back after it."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; sizes of shuffles stay with the cluster and AQE."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where none is named, a session on local cores (tests) gets one of its own; on a cluster a folder
    that executors do not share would lose rows, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="runlumen-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; sessions that share it never meet."""
    return f"{_PASSING.get() or checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate several steps read to the shared folder and read it back.

    It is computed once, cuts the lineage, and its files outlive lost executors.
    """
    spark = df.sparkSession
    folder = scratch(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def passing(spark: SparkSession, label: str) -> Iterator[None]:
    """What is staged inside the block goes when it ends; nothing may read it later."""
    folder = scratch(spark, label)
    token = _PASSING.set(folder)
    try:
        yield
    finally:
        _PASSING.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_buckets(df: DataFrame, label: str, key: str, buckets: int) -> str:
    """Write ``df`` as a bucketed table into the shared folder; returns the table's name.

    A task that holds one bucket writes one file and sorts nothing for it.
    """
    spark = df.sparkSession
    folder = scratch(spark, label)
    name = "runlumen_" + folder.rsplit("/", 1)[1].replace("-", "_")
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "4"}):
        df.write.format("parquet").option("compression", "zstd").option("path", folder).bucketBy(
            buckets, key).saveAsTable(name)
    return name


def all_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def require_limit(limit: int) -> int:
    """Row limits are integers in 1..100."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 100:
        raise ValueError("QUERY_LIMIT_INVALID")
    return limit
