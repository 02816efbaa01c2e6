"""Session construction and the one place that decides where staged tables live."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TIMESTAMPS, MICROS = "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_local_root: str | None = None
_staged: dict[str, list[str]] = {}  # by application


def build_session(app: str = "eventmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config(TIMESTAMPS, MICROS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


@contextmanager
def micros(spark: SparkSession):
    """Times are stored as microseconds inside: Spark's old default has no statistics to prune by."""
    before = spark.conf.get(TIMESTAMPS)
    spark.conf.set(TIMESTAMPS, MICROS)
    try:
        yield
    finally:
        spark.conf.set(TIMESTAMPS, before)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder for one staged table, below ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: executors of a
    cluster do not share one.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="eventmill-")
        root = _local_root
    return f"{root.rstrip('/')}/eventmill/{label}-{uuid.uuid4().hex}"


def discard_staged(spark: SparkSession) -> int:
    """Remove the tables this session's application staged. Call it when no result depends on them any more."""
    from eventmill.sources.files import remove

    return sum(remove(spark, path) for path in _staged.pop(spark.sparkContext.applicationId, []))


def stage(df, label: str):
    """Write ``df`` once below the shared folder and read it back.

    Cuts the lineage and survives the loss of executors, as the files belong to
    no executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    with micros(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_clean(df, label: str):
    """``stage``, without leaving the files of its shuffles behind: else they stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN)
    conf.set(CLEAN, "true")
    try:
        return stage(df, label)
    finally:
        conf.set(CLEAN, before)
