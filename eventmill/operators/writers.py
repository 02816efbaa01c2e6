"""Table writes: overwrite, append, keyed upsert, compaction, retention, health."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.operators import changes
from eventmill.operators.ordering import newest_per_key
from eventmill.session import micros
from eventmill.sources.files import child_dirs, exists, has_data, remove
from eventmill.sources.tables import read_table

log = logging.getLogger(__name__)

TARGET_FILE_BYTES = 128 * 1024 * 1024


def rebalanced(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.hint("rebalance", *columns)


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    partition_by: list[str] = (),
    single_file: bool = False,
) -> None:
    """``single_file`` is for small gold tables only.

    Partitioned writes are rebalanced by partition: few files for a small one,
    and a hot one is split over several tasks.
    """
    if single_file:
        df = df.coalesce(1)
    elif partition_by:
        df = rebalanced(df, partition_by)
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with micros(df.sparkSession):
        writer.save(path)


def append_if_any(df: DataFrame | None, path: str) -> bool:
    if df is None or df.isEmpty():
        return False
    write_table(df, path, "append")
    return True


def with_retry(
    action: Callable[[], None],
    attempts: int = 3,
    base_seconds: float = 1.0,
    cap_seconds: float = 30.0,
    sleep: Callable[[float], None] = time.sleep,
) -> None:
    """Run an action again after a failed Spark job, waiting 1, 2, 4 ... seconds.

    A query that does not analyse would fail again, so it is raised at once.
    """
    for n in range(attempts):
        try:
            return action()
        except AnalysisException:
            raise
        except PySparkException as e:
            if n + 1 == attempts:
                raise
            log.warning("attempt %d failed: %s", n + 1, str(e).splitlines()[0])
            sleep(min(cap_seconds, base_seconds * 2**n))


def append_evolving(df: DataFrame, path: str, attempts: int = 3, key: str | None = None) -> bool:
    """Create or append; batches may differ in columns, readers merge them.

    A batch counts once its write has finished, so no attempt leaves rows twice. A caller
    that may run again names the batch by ``key``, which is then published once.
    """
    name, done = key or uuid.uuid4().hex, []
    with_retry(lambda: done.append(changes.publish(df, path, name)), attempts)
    return done[-1]


def read_evolving(spark: SparkSession, path: str) -> DataFrame | None:
    return changes.read_published(spark, path)


def validated_write(
    df: DataFrame,
    path: str,
    partition_by: list[str] = (),
    valid: Callable[[DataFrame], Column] | None = None,
    attempts: int = 3,
    key: str | None = None,
) -> bool:
    """Validate in one aggregation, publish as one batch with retries, then check the stored schema.

    ``valid`` turns the frame into one boolean aggregate; False refuses the batch. Read
    the table with :func:`read_evolving`; ``key`` as in :func:`append_evolving`.
    """
    if valid is not None and not df.agg(valid(df).alias("ok")).first().ok:
        return False
    rows, name = rebalanced(df, partition_by) if partition_by else df, key or uuid.uuid4().hex
    with_retry(lambda: changes.publish(rows, path, name, partition_by), attempts)
    missing = set(df.columns) - set(read_evolving(df.sparkSession, path).columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)} after the write")
    return True


def register_table(df: DataFrame, path: str, name: str, partition_by: list[str]) -> None:
    """Append to partitioned files and make them known under a name."""
    writer = rebalanced(df, partition_by).write.mode("append").format("parquet").partitionBy(*partition_by)
    with micros(df.sparkSession):
        writer.option("path", path).saveAsTable(name)


def ensure_tables(spark: SparkSession, paths: dict[str, T.StructType]) -> list[str]:
    """Create missing tables empty and typed; returns those created."""
    created = []
    for path, schema in paths.items():
        if not has_data(spark, path):
            spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)
            created.append(path)
    return created


def write_json_by_type(df: DataFrame, path: str, job_id: str, written_at: Column) -> None:
    """JSON lines in ``event_type=/date=`` folders."""
    rows = df.withColumns(
        {
            "job_id": F.lit(job_id),
            "bronze_written_at": written_at,
            "date": F.date_format(written_at, "yyyy-MM-dd"),
            "event_type": F.coalesce("event_type", F.lit("unknown")),
        }
    )
    write_table(rows, path, "append", "json", ["event_type", "date"])


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of every data file; the content column is pruned, so nothing is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length")


def json_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows, files and bytes per event type."""
    rows = spark.read.schema(schema).json(path).groupBy("event_type").agg(F.count("*").alias("event_count"))
    kind = F.regexp_extract("path", r"event_type=([^/]*)", 1).alias("event_type")
    sizes = files_of(spark, path).groupBy(kind).agg(
        F.count("*").alias("files"), F.sum("length").alias("file_size_bytes")
    )
    return rows.join(sizes, "event_type", "left")


# --- keyed upsert --------------------------------------------------------------------
def _versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first. A version counts once its write has finished."""
    names = [n for n in child_dirs(spark, path) if n.startswith("v=")]
    return sorted(int(n[2:]) for n in names if exists(spark, f"{path}/{n}/_SUCCESS"))


def _version_path(path: str, version: int) -> str:
    return f"{path}/v={version:08d}"


def read_current(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The newest finished version of an upserted table."""
    versions = _versions(spark, path)
    return read_table(spark, _version_path(path, versions[-1]), schema) if versions else None


def write_version(df: DataFrame, path: str) -> int:
    """Write a whole new version beside the current one; readers switch when it is complete."""
    versions = _versions(df.sparkSession, path)
    version = versions[-1] + 1 if versions else 1
    write_table(df, _version_path(path, version))
    return version


def _merged(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` without a newer row, plus all updates.

    Updates are unique per key, so this is a key-to-key join without hot keys,
    and a small batch of updates is broadcast so that the target does not move.
    """
    fresh = updates.select(*[F.col(k).alias(f"_u{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_u{i}"))
    return target.join(fresh, same, "left_anti").unionByName(updates, allowMissingColumns=True)


def _unique(updates: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    return newest_per_key(updates, keys, order) if order else updates.dropDuplicates(keys)


def upsert(updates: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> int:
    """Matched keys are replaced, others inserted, by rewriting the table: for small tables.
    Applying a batch twice changes nothing.

    Of several updates for a key the newest by ``order`` counts. One writer at a
    time is assumed.
    """
    spark = updates.sparkSession
    updates = _unique(updates, keys, order)
    target = read_current(spark, path)
    return write_version(updates if target is None else _merged(target, updates, keys), path)


def read_partitions(spark: SparkSession, path: str, column: str, values: list, kind: T.DataType) -> DataFrame | None:
    """Rows of the named partitions, NULL included: one scan, pruned by a filter; None without data."""
    if not has_data(spark, path):
        return None
    # the column keeps the type of its writer, which type inference from folder names would change
    stored = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(column, kind) if f.name == column else f for f in stored])
    named = [v for v in values if v is not None]
    wanted = F.col(column).isin([F.lit(v).cast(kind) for v in named]) if named else F.lit(False)
    if len(named) < len(values):
        wanted = wanted | F.col(column).isNull()
    return spark.read.schema(schema).parquet(path).filter(wanted)


def upsert_partitions(
    updates: DataFrame,
    path: str,
    keys: list[str],
    partition: str,
    order: list[str] | None = None,
    unique: bool = False,
    touched: list | None = None,
) -> None:
    """Upsert that rewrites only the partitions the updates fall in.

    ``unique`` says that the updates already hold one row per key; ``touched``
    names their partitions where the caller knows them, which saves a job.

    Only valid when ``partition`` is a function of the key: a key whose partition
    could change would leave its old row behind. For tables of small partitions that are
    rewritten as a whole anyway; keys all over a table belong in :mod:`changes`.
    """
    spark = updates.sparkSession
    if not unique:
        updates = _unique(updates, keys, order)
    merged = updates
    # as many values as partitions are touched
    if touched is None:
        touched = [r[0] for r in updates.select(F.col(partition).cast("string")).distinct().collect()]
    target = read_partitions(spark, path, partition, touched, updates.schema[partition].dataType)
    if target is not None:
        merged = _merged(target, updates, keys)
    with micros(spark):
        (
            rebalanced(merged, [partition])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition)
            .parquet(path)
        )


# --- maintenance --------------------------------------------------------------------
def folder_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(hpath).getLength()


def clustered(df: DataFrame, columns: list[str], files: int) -> DataFrame:
    """Range-partitioned and sorted by the clustering columns, so that file statistics prune.

    The row position breaks ties, so that one hot value is split over several files.
    """
    cols = [F.col(c) for c in columns]
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.repartitionByRange(files, *cols, F.col("_row")).sortWithinPartitions(*cols).drop("_row")


def compact(spark: SparkSession, path: str, columns: list[str], target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """Rewrite the current version into few clustered files; reports file counts before and after."""
    version = _versions(spark, path)[-1]
    before = _version_path(path, version)
    files = max(1, -(-folder_bytes(spark, before) // target_bytes))
    after = _version_path(path, write_version(clustered(read_table(spark, before), columns, files), path))
    counts = [
        files_of(spark, p).filter(F.col("path").endswith(".parquet")).agg(F.count("*").alias(n)).scalar()
        for p, n in ((before, "b"), (after, "a"))
    ]
    return read_table(spark, after).agg(F.count("*").alias("rows")).withColumns(
        {"files_before": counts[0], "files_after": counts[1]}
    )


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the newest finished versions."""
    old = _versions(spark, path)[:-keep]
    for v in old:
        remove(spark, _version_path(path, v))
    return old


def drop_old_partitions(spark: SparkSession, path: str, column: str, cutoff: str) -> list[str]:
    """Remove ``column=<day>`` folders older than the cutoff day (ISO text)."""
    old = [n for n in child_dirs(spark, path) if n.startswith(f"{column}=") and n.split("=", 1)[1] < cutoff]
    for n in old:
        remove(spark, f"{path}/{n}")
    return old


def table_health(spark: SparkSession, path: str, partition: str | None = None) -> DataFrame:
    """Files, rows and bytes per partition, and whether a partition has too many small files.

    Row counts come from the scan's own metadata columns; no data column is read.
    """
    per_file = spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), *([partition] if partition else [])
    )
    keys = [partition] if partition else []
    files = per_file.groupBy("file", "bytes", *keys).agg(F.count("*").alias("rows"))
    report = files.groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")
    )
    small = (F.col("files") > 1) & (F.col("bytes") / F.col("files") < TARGET_FILE_BYTES / 16)
    return report.withColumn("issue", F.when(small, "small_files"))


def missing_table_report(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return ["table_directory_missing"]
    return [] if has_data(spark, path) else ["no_data_files"]
