"""Changes between two versions of a table, and applying them to an index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def change_feed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and ``old`` that differ, each with its ``change``.

    Keys are unique in both. An update gives the row before and the row after.
    """
    columns = old.columns
    row = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns])
    match = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    o = old.withColumn("__there", F.lit(True)).alias("o")
    n = new.select(*columns).withColumn("__there", F.lit(True)).alias("n")
    gone, came = F.col("n.__there").isNull(), F.col("o.__there").isNull()
    change = lambda kind, side: F.struct(F.lit(kind).alias("change"), row(side).alias("row"))
    changes = (
        F.when(came, F.array(change("insert", "n")))
        .when(gone, F.array(change("delete", "o")))
        .when(
            ~row("o").eqNullSafe(row("n")),
            F.array(change("update_pre", "o"), change("update_post", "n")),
        )
    )
    return (
        o.join(n, match, "full_outer")
        .select(F.explode(changes).alias("c"))
        .select("c.change", "c.row.*")
    )


def sync_index(index: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The index after the changes; with no index, the index made from them."""
    live = changes.filter(F.col("change").isin("insert", "update_post")).drop("change")
    if index is None:
        return live
    touched = changes.filter(F.col("change").isin("update_pre", "delete"))
    touched = touched.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return index.join(touched, same, "left_anti").unionByName(live)
