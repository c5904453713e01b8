"""File and in-memory sources."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..defaults import BATCH_BYTES
from ..schemas import RAW_FILES
from ..session import few_listing_tasks


def read_files_stream(
    spark: SparkSession, folder: str, glob: str = "*.pdf", max_files: int | None = None,
    max_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Stream of files below ``folder``: each matching file is delivered once.

    ``max_bytes`` bounds a micro-batch, so that a first run over a large
    folder is cut into batches of a steady size, however small its files are;
    ``max_files``, if given, bounds it by their number instead.
    """
    bound = ("maxBytesPerTrigger", max_bytes) if max_files is None else ("maxFilesPerTrigger", max_files)
    with few_listing_tasks(spark):
        return (
            spark.readStream.format("binaryFile")
            .schema(RAW_FILES)
            .option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true")
            .option(*bound)
            .load(folder)
        )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Batch scan of one table of a parquet folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Rows of a scan over all cores, if its files give fewer splits than there are cores.

    For scans ahead of heavy row work. A table of many files or row groups
    has enough splits and is left as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def view(df: DataFrame, name: str) -> DataFrame:
    """Name a frame for SQL and give it back."""
    df.createOrReplaceTempView(name)
    return df


def from_rows(
    spark: SparkSession, rows: Iterable[tuple] | Iterable[Mapping] | pd.DataFrame, schema: StructType
) -> DataFrame:
    """Rows or a pandas frame as a frame with a declared schema."""
    data = rows if isinstance(rows, pd.DataFrame) else list(rows)
    return spark.createDataFrame(data, schema)
