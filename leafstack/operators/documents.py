"""Documents to pages, pages to chunks, chunks to vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..defaults import CHUNK_OVERLAP, CHUNK_SIZE, EMBED_BATCH, PATH_SCHEME
from ..functions import text as tx
from ..functions.udfs import chunker_udf, embedding_udf, hash_embed, parser_error_udf, parser_udf
from .skew import number_rows


def normalise_path(df: DataFrame) -> DataFrame:
    """Keep the path as ``url`` and strip every scheme mark from ``path``."""
    return df.withColumn("url", F.col("path")).withColumn(
        "path", F.replace("path", F.lit(PATH_SCHEME), F.lit(""))
    )


def parse_pages(df: DataFrame, parser: Callable, content: str = "content") -> DataFrame:
    """Add ``pages`` with a user's parser; NULL for a document it fails on."""
    return df.withColumn("pages", parser_udf(parser)(content))


def rejected(parsed: DataFrame) -> DataFrame:
    """The documents a parser failed on."""
    return parsed.filter(F.col("pages").isNull()).drop("pages")


def reject_rows(files: DataFrame, parser: Callable | None = None, content: str = "content") -> DataFrame:
    """``path, error`` of the files that give no pages: the parser's error, or that they are no UTF-8 text."""
    if parser is None:
        bad = F.col(content).isNull() | F.try_validate_utf8(F.col(content).cast("string")).isNull()
        error = F.when(bad, F.lit("not UTF-8 text"))
    else:
        error = parser_error_udf(parser)(content)
    return files.select("path", error.alias("error")).filter(F.col("error").isNotNull())


def explode_pages(df: DataFrame, parser: Callable | None = None, content: str = "text") -> DataFrame:
    """One row per page ``(title, page_number, text)``, page numbers from 0.

    Without a parser, ``content`` is text with form feeds between its pages and
    ``title`` is kept. A document without pages gives no row.
    """
    if parser is None:
        keep = [c for c in df.columns if c not in (content, "page_number", "text")]
        return df.select(
            *keep,
            F.posexplode(F.split(F.regexp_replace(content, r"\f\z", ""), "\f"))
            .alias("page_number", "text"),
        )
    parsed = df if "pages" in df.columns else parse_pages(df, parser, content)
    keep = [c for c in df.columns if c not in (content, "pages", "title", "page_number", "text")]
    return parsed.select(*keep, F.explode("pages").alias("page")).select(*keep, "page.*")


def _explode_chunks(df: DataFrame, chunks, text: str) -> DataFrame:
    keep = [c for c in df.columns if c not in (text, "chunk_no", "content")]
    return df.select(*keep, F.posexplode(chunks).alias("chunk_no", "content"))


def chunk_sections(df: DataFrame, text: str = "text", strip_marks: bool = False) -> DataFrame:
    """One row per markdown section of a page."""
    return _explode_chunks(df, tx.sections(F.col(text), strip_marks), text)


def chunk_sentences(
    df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text"
) -> DataFrame:
    """One row per chunk of whole sentences; the packing is a fold of column functions, no Python."""
    return _explode_chunks(df, tx.sentence_chunks(F.col(text), size, overlap), text)


def chunk_windows(
    df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "text"
) -> DataFrame:
    """One row per fixed window of words."""
    return _explode_chunks(df, tx.windows(F.col(text), size, overlap), text)


def chunk_with(df: DataFrame, chunker: Callable[[str], list[str]], text: str = "text") -> DataFrame:
    """One row per chunk of a user's chunker."""
    return _explode_chunks(df, chunker_udf(chunker)(text), text)


def isolate_tables(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two frames: the pages without their tables, and one row per table."""
    keep = [c for c in df.columns if c != text]
    pages = df.withColumn(text, tx.prose(F.col(text)))
    tables = df.select(*keep, F.posexplode(tx.tables(F.col(text))).alias("table_no", "content"))
    return pages, tables


def with_headings(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(tx.has_heading(F.col(text)))


def assign_ids(df: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """Unique, consecutive ids in the order of ``order``."""
    return number_rows(df, order, "id", start)


def hash_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ids that need no shuffle and stay the same on retry.

    64 bits of hash are not collision-free beyond some 10^9 rows; use
    ``assign_ids`` where ids must be unique.
    """
    return df.withColumn("id", F.xxhash64(*keys))


def embed(
    df: DataFrame, col: str = "content", fn: Callable = hash_embed, batch_size: int = EMBED_BATCH
) -> DataFrame:
    return df.withColumn("embedding", embedding_udf(fn, batch_size)(col))


def final_chunks(df: DataFrame) -> DataFrame:
    return df.select(
        "path", "title", "url", F.col("page_number").cast("int").alias("page_number"),
        "content", "embedding",
    )


def preprocess(
    df: DataFrame,
    parser: Callable | None = None,
    chunk: Callable[[DataFrame], DataFrame] = chunk_sections,
    fn: Callable = hash_embed,
    content: str = "text",
) -> DataFrame:
    """Files to embedded chunks; nothing here shuffles, so it also runs on a stream."""
    return final_chunks(embed(page_chunks(df, parser, chunk, content), fn=fn))


def page_chunks(
    df: DataFrame, parser: Callable | None = None,
    chunk: Callable[[DataFrame], DataFrame] = chunk_sections, content: str = "text",
) -> DataFrame:
    """Files to chunks, not yet embedded: the place to give ids that need a sort."""
    return chunk(explode_pages(normalise_path(df), parser, content))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("path").agg(F.count(F.lit(1)).alias("pages"))


def known_paths(chunks: DataFrame) -> DataFrame:
    return chunks.select("path").distinct()
