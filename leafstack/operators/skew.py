"""Numbering of rows without a window over all of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settled


def number_rows(
    df: DataFrame, order: list[str | Column], name: str, start: int = 0, partitions: int | None = None
) -> DataFrame:
    """Consecutive numbers in a total order, without a single-task window.

    Rows are range-partitioned and sorted, written once to the checkpoint
    folder with their place in the partition, and shifted by the sizes of the
    partitions before, a table of one row per partition.
    """
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    by_range = [partitions, *cols] if partitions else cols
    placed = settled(
        df.repartitionByRange(*by_range)
        .sortWithinPartitions(*cols)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    sizes = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, total = [], start
    for row in sorted(sizes, key=lambda r: r["__pid"]):
        offsets.append({"__pid": row["__pid"], "__base": total})
        total += row["n"]
    # from Arrow, as rows of Python objects would pass through Python workers
    schema = pa.schema([("__pid", pa.int32()), ("__base", pa.int64())])
    table = spark.createDataFrame(pa.Table.from_pylist(offsets, schema))
    return (
        placed.join(F.broadcast(table), "__pid")
        .withColumn(name, F.col("__base") + F.col("__seq"))
        .drop("__pid", "__seq", "__base")
    )
