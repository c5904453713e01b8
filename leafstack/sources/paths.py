"""Directories of shared storage, by the Hadoop file system of their path."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def levels(spark: SparkSession, pattern: str) -> list[dict[str, int]]:
    """The ``name=number`` levels of the directories and files that match."""
    path, fs = _path(spark, pattern)
    depth = pattern.count("=")
    out = []
    for status in fs.globStatus(path) or []:
        parts = [p.split("=") for p in status.getPath().toString().split("/") if "=" in p]
        out.append({name: int(number) for name, number in parts[-depth:]})
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def stream_number(spark: SparkSession, checkpoint: str) -> int:
    """A number for the stream behind a checkpoint folder.

    It stays the same over restarts. A stream that starts over with a new
    folder gets another one, so its batches are not taken for repeated ones.
    """
    text = "".join(r["value"] for r in spark.read.text(f"{checkpoint}/metadata").collect())
    return int(json.loads(text)["id"].replace("-", "")[:12], 16)
