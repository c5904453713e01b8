"""Arrow batches of documents cut to a bounded number of bytes, and what tasks on them leave behind."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def bodies(documents: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc_id, body``: texts as bytes, NULL as empty; the ids keep their type."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return documents.select(F.col(id_col).alias("doc_id"), text.alias("body"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        data = batch.column(column)
        start, held = 0, 0
        for i in range(len(data)):
            n = len(data[i].as_buffer()) if data[i].is_valid else 0
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(data):
            yield batch.slice(start)


def releasing(work: Callable) -> Callable:
    """``work`` (for ``mapInArrow``), after which a task gives freed memory back to the system.

    Workers outlive tasks and stages; what their allocators keep counts as the executor's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run
