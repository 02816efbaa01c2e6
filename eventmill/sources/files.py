"""Hadoop file system helpers (work on any store Spark can reach)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath) and fs.getFileStatus(hpath).isFile()


def child_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory())


def has_data(spark: SparkSession, path: str) -> bool:
    """True when the folder holds at least one entry that Spark would read."""
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        return False
    names = [s.getPath().getName() for s in fs.listStatus(hpath)]
    return any(not n.startswith(("_", ".")) for n in names)


def make_dirs(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, hpath = _fs(spark, path)
        fs.mkdirs(hpath)


def remove(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.delete(hpath, True)
