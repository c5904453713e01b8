"""Incremental load in two stages: files to a raw table, raw table to chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.udfs import hash_embed
from ..operators.documents import (
    assign_ids, chunk_sections, embed, explode_pages, hash_ids, known_paths, normalise_path, reject_rows,
)
from ..schemas import CHUNKS
from ..session import few_listing_tasks
from ..sources import qualified, read_files_stream, read_table_stream, write_stream
from ..sources.paths import levels, stream_number

_PLACE = ["path", "page_number", "chunk_no"]


def ingest_raw(
    spark: SparkSession, folder: str, table: str, checkpoint: str, glob: str = "*.pdf",
    location: str | None = None, max_files: int | None = None,
) -> StreamingQuery:
    """New files of a folder to the raw table, each once."""
    stream = read_files_stream(spark, folder, glob, max_files)
    return write_stream(stream, table, checkpoint, location)


def _pages(raw: DataFrame, parser: Callable | None) -> DataFrame:
    """Pages of the files, by a parser or as text; a file that is neither gives none."""
    raw = normalise_path(raw.select("path", "content"))
    if parser is not None:
        return explode_pages(raw, parser, "content")
    text = raw.select(
        "path", "url", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    )
    return explode_pages(text)


def ingest_rejects(
    spark: SparkSession, raw: str, table: str, checkpoint: str, parser: Callable | None = None,
    location: str | None = None,
) -> StreamingQuery:
    """New rows of the raw table that give no pages to a table of ``path, error``, whichever stage makes the chunks."""
    rows = normalise_path(read_table_stream(spark, raw).select("path", "content"))
    return write_stream(reject_rows(rows, parser), table, checkpoint, location)


def ingest_chunks(
    spark: SparkSession, raw: str, table: str, checkpoint: str, parser: Callable | None = None,
    chunk: Callable[[DataFrame], DataFrame] = chunk_sections, fn: Callable = hash_embed,
    location: str | None = None,
) -> StreamingQuery:
    """New rows of the raw table to embedded chunks with hashed ids; no state, no shuffle."""
    rows = hash_ids(chunk(_pages(read_table_stream(spark, raw), parser)), _PLACE)
    return write_stream(embed(rows, fn=fn).select(*CHUNKS.fieldNames()), table, checkpoint, location)


def ingest_numbered_chunks(
    spark: SparkSession, raw: str, folder: str, checkpoint: str, parser: Callable | None = None,
    chunk: Callable[[DataFrame], DataFrame] = chunk_sections, fn: Callable = hash_embed,
) -> StreamingQuery:
    """As ``ingest_chunks``, with unique consecutive ids that go on from batch to batch.

    Each batch owns a directory of ``folder``, by stream and batch. A batch
    that is run again counts from the others and replaces its own directory,
    so its rows and ids come out the same. The last id of each batch is kept
    in a small file (``folder/_last``), so that a batch reads no earlier chunks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = stream_number(session, checkpoint)
        last = 0
        if levels(session, f"{folder}/_last/stream=*"):
            ids = session.read.schema("last bigint, stream bigint, batch_id bigint").parquet(f"{folder}/_last")
            mine = (F.col("stream") == stream) & (F.col("batch_id") == batch_id)
            last = ids.filter(~mine).agg(F.max("last").alias("m")).head()["m"] or 0
        rows = assign_ids(chunk(_pages(batch, parser)), _PLACE, last + 1)
        place = f"stream={stream}/batch_id={batch_id}"
        embed(rows, fn=fn).select(*CHUNKS.fieldNames()).write.mode("overwrite").parquet(f"{folder}/{place}")
        written = session.read.schema(CHUNKS).parquet(f"{folder}/{place}")
        written.agg(F.coalesce(F.max("id"), F.lit(last)).alias("last")).write.mode("overwrite").parquet(f"{folder}/_last/{place}")

    with few_listing_tasks(spark):
        query = (
            read_table_stream(spark, raw).writeStream.trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).foreachBatch(write).start()
        )
        query.awaitTermination()
    return query


def load_all(
    spark: SparkSession, folder: str, raw: str, table: str, root: str, glob: str = "*.pdf",
    parser: Callable | None = None, chunk: Callable[[DataFrame], DataFrame] = chunk_sections,
    fn: Callable = hash_embed,
) -> DataFrame:
    """Both stages, then the paths known so far, as a frame.

    ``root`` holds the two tables and the two checkpoints. A later call takes
    up only the files that are new.
    """
    ingest_raw(spark, folder, raw, f"{root}/progress/raw", glob, f"{root}/raw")
    ingest_chunks(
        spark, raw, table, f"{root}/progress/chunks", parser, chunk, fn, f"{root}/chunks"
    )
    spark.catalog.refreshTable(qualified(table))
    return known_paths(spark.table(qualified(table)))
