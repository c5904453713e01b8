"""Words of texts as bounded rows, with column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

# What parts words (after lower-casing A-Z), and the same for text in any case.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENT = 256


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and every other letter as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; NULL has none."""
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), PARTING), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def segments(documents: DataFrame, keys: list[Column], text: Column, overlap: int, size: int = SEGMENT) -> DataFrame:
    """``*keys, first, words``: texts as rows of at most ``size + overlap`` words.

    ``first`` is the number of the row's first word. Rows overlap by
    ``overlap`` words: every run of up to ``overlap + 1`` words lies whole in
    the row in whose first ``size`` words it starts. Texts without words have
    no rows.
    """
    cut = let(words(text), lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int"))),
        lambda i: F.struct(
            (i.cast("bigint") * size).alias("first"), F.slice(w, i * size + 1, size + overlap).alias("words")
        ),
    ))
    rows = documents.select(*keys, F.explode(cut).alias("row"))
    return rows.select(*[F.col(c) for c in rows.columns[:-1]], "row.first", "row.words").filter(F.size("words") > 0)


def starts(words_: Column, length: int, size: int = SEGMENT) -> Column:
    """Places (from 0) in a segment at which runs of ``length`` words start, within its first ``size`` words."""
    last = F.least(F.lit(size), F.size(words_) - length + 1)
    return F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
