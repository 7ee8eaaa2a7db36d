"""Published versions of a folder of tables: one small file a version, readable only when it is whole.

Data files are never changed after they were written. A version names the files that
are in force; publishing it is one write that fails if the number is taken, so of two
writers one loses and nothing is half replaced. Readers keep the version that they opened.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Versions that were published in full."""
    return [int(n[2:]) for n in names_in(spark, f"{root}/manifest") if n.startswith("v=") and exists(spark, f"{root}/manifest/{n}/_SUCCESS")]


def publish(spark: SparkSession, root: str, number: int, told: dict) -> None:
    """Fails if another writer has published this number."""
    row = spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1)
    row.write.mode("error").text(f"{root}/manifest/v={number:06d}")


def read(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict]:
    """The latest version, or a given one, with its number."""
    found = numbers(spark, root)
    if not found or number is not None and number not in found:
        raise FileNotFoundError(f"no version in {root}" if number is None else f"no version {number} in {root}")
    number = found[-1] if number is None else number
    return number, json.loads(spark.read.text(f"{root}/manifest/v={number:06d}").first().value)
