"""Folders of the shared store, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _open(spark, folder)
    return files.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    path, files = _open(spark, folder)
    files.delete(path, True)


def numbered_folders(spark: SparkSession, folder: str, name: str, finished: bool = True) -> list[int]:
    """The numbers n of the folders name=n in a folder, in order; of finished writes only, unless told otherwise."""
    path, files = _open(spark, folder)
    if not files.exists(path):
        return []
    found = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}=") and (not finished or exists(spark, f"{folder}/{n}/_SUCCESS")))
