"""Latest-row and grouping operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``.

    The filter on the row number becomes a limit per key that also runs before
    the shuffle: a hot key sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def retrieval_rows(assessments: DataFrame) -> DataFrame:
    """Retrieval assessments in long form, one row each: what later steps should read."""
    return assessments.filter(F.col("retrieval_assessment").isNotNull()).select(
        "request_id", "source", "step_id", "timestamp", "retrieval_assessment",
        F.col("source.id").alias("source_id"),
    )


def retrieval_keys(assessments: DataFrame) -> DataFrame:
    """One row per request, reviewer and step with retrieval assessments, without their lists."""
    keys = ["request_id", "source_id", "step_id"]
    return retrieval_rows(assessments).groupBy(*keys).agg(F.max("source").alias("source")).drop("source_id")


def collect_retrieval(assessments: DataFrame) -> DataFrame:
    """Retrieval assessments per request, reviewer and step, as one sorted list each.

    There is one row per key at any size: the list is the output, so its
    length is the key's own. Rows of a key are gathered in each task first.
    """
    return (
        retrieval_rows(assessments).groupBy("request_id", "source_id", "step_id")
        .agg(
            F.max("timestamp").alias("timestamp"),
            F.max("source").alias("source"),
            F.sort_array(F.collect_list("retrieval_assessment")).alias("retrieval_assessments"),
        )
        .drop("source_id")
    )


def latest_version(df: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """The highest version of each name as a number; versions that are none do not count."""
    number = F.col(version).try_cast("bigint")
    return df.groupBy(name).agg(F.max_by(version, number).alias(version))
