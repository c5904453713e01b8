"""Catalog objects, table streams and the run-to-completion sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import CHUNKS, PARTS, ddl
from ..session import few_listing_tasks


def qualified(name: str) -> str:
    """``schema.table`` with every part in back-ticks."""
    parts = [p.strip("`") for p in name.split(".")]
    return ".".join(f"`{p}`" for p in parts)


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> str:
    """Create the schema unless it exists, and make it current."""
    plain = name.strip("`")
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {qualified(plain)}{where}")
    spark.catalog.setCurrentDatabase(plain)
    return plain


def _ensure_table(spark, name, columns, location):
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {qualified(name)} ({columns}) USING parquet{where}")
    return spark.table(qualified(name))


def ensure_chunks(spark: SparkSession, name: str, location: str | None = None) -> DataFrame:
    """The chunk table. Parquet has no identity columns; see ``assign_ids``."""
    return _ensure_table(spark, name, ddl(CHUNKS), location)


def ensure_parts(spark: SparkSession, name: str, location: str | None = None) -> DataFrame:
    return _ensure_table(spark, name, ddl(PARTS), location)


def read_table_stream(spark: SparkSession, name: str) -> DataFrame:
    """Stream of the rows appended to a table."""
    return spark.readStream.table(qualified(name))


def write_stream(
    df: DataFrame, table: str, checkpoint: str, path: str | None = None
) -> StreamingQuery:
    """Append everything available to ``table``, remember the progress, stop.

    The file sink keeps a log of committed batches, so a retried batch adds
    no row twice.
    """
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
    )
    if path:
        writer = writer.option("path", path)
    with few_listing_tasks(df.sparkSession):
        query = writer.toTable(qualified(table))
        query.awaitTermination()
    return query
