"""A pointer that names the parts of a table in use: readers see one version, whole."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _folders(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, ([s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else [])


def publish(spark: SparkSession, root: str, number: int, parts: list[str]) -> None:
    """Make `parts` version `number`. A version counts once Spark has committed its folder, so half of one is never read."""
    spark.createDataFrame([(json.dumps(parts),)], "parts string").coalesce(1).write.mode("overwrite").text(f"{root}/version={number}")


def current(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, list[str]]:
    """(number, parts) of the newest version, or of the newest one before a number; (-1, []) if there is none."""
    fs, folders = _folders(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    numbers = [int(f.getName().removeprefix("version=")) for f in folders if f.getName().startswith("version=") and fs.exists(path(f, "_SUCCESS"))]
    numbers = [n for n in numbers if before is None or n < before]
    if not numbers:
        return -1, []
    return max(numbers), json.loads(spark.read.text(f"{root}/version={max(numbers)}").first()[0])


def drop_unused(spark: SparkSession, root: str, parts_root: str, versions: int = 2) -> None:
    """Delete parts that none of the newest `versions` versions names, and the versions before those."""
    numbers, number = [], None
    used: set[str] = set()
    while len(numbers) < versions and (found := current(spark, root, number))[0] >= 0:
        number = found[0]
        numbers.append(number)
        used |= set(found[1])
    for folder in _folders(spark, parts_root)[1]:
        if folder.getName() not in used:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    for folder in _folders(spark, root)[1]:
        if numbers and int(folder.getName().removeprefix("version=")) < min(numbers):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
