"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import remainder

#: Tickets are 62 bits of a hash, so that a rate as low as 2^-62 is still kept exactly.
TICKETS = 1 << 62


def labelled(labels: DataFrame, label: str, allowed: Column, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, label`` (0 or 1) of the ids a model may learn from.

    NULL ids and NULL labels are left out; of repeated ids the majority
    counts, 1 in a tie.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & allowed)
    return rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def sample(rows: DataFrame, by: str, bound: int, seed: int = 11) -> DataFrame:
    """About ``bound`` rows of each value of ``by``, or all where there are fewer, chosen by a hash of the id.

    The driver holds one rate per value of ``by``; a rate is a whole number of
    tickets out of 2^62, rounded up, so the sample is within a ticket of
    ``bound`` rows in expectation at any size.
    """
    counts = rows.groupBy(by).count().collect()
    keep = F.lit(False)
    ticket = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(TICKETS))
    for row in counts:
        limit = min(TICKETS, -(-TICKETS * bound // row["count"]))
        keep = keep | ((F.col(by) == row[by]) & (ticket < F.lit(limit)))
    return rows.filter(keep)


def held_out(modulus: int, value: int) -> Column:
    """True for the ids that no model learns labels from; false for a NULL id, which nothing learns from either."""
    return F.coalesce(remainder(F.col("doc_id"), modulus) == value, F.lit(False))
