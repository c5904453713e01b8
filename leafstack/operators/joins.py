"""Keyed lookups and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def lookup(df: DataFrame, features: DataFrame, key: str, feature_key: str | None = None) -> DataFrame:
    """Add the feature columns of each row's key; NULLs where there are none.

    No hint is given: Spark broadcasts the features if they are small, and
    AQE splits hot keys of ``df`` if they are not.
    """
    feature_key = feature_key or key
    if feature_key == key:
        return df.join(features, key, "left")
    return df.join(features, df[key] == features[feature_key], "left").drop(feature_key)


def _any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def _salt(columns: list[str], keys: list[str]) -> Column:
    """A further key: zero, or the hash of a row whose key has a NULL, which so meets no other row of its key's hash."""
    return F.when(_any_null(keys), F.xxhash64(*columns)).otherwise(F.lit(0).cast("bigint"))


def replace_by_key(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target after its rows give way to the source's rows of the same key; keys may repeat on either side.

    All source rows are in the result, as often as they come, and the target's
    rows of other keys. A NULL in a key matches nothing. Only the target and
    the distinct keys of the source are shuffled.
    """
    columns = target.columns
    named = source.select(*keys).filter(~_any_null(keys)).distinct().withColumn("__salt", F.lit(0).cast("bigint"))
    kept = target.withColumn("__salt", _salt(columns, keys)).join(named, [*keys, "__salt"], "left_anti")
    return kept.select(*columns).unionByName(source.select(*columns))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target after a merge: matched rows take all source values, others are added.

    A NULL in a key matches nothing; such rows get a hash of themselves as a
    further key, so they spread over all tasks. Two source rows with one key
    are an error, raised by the task that sees them; the check uses the join's
    own shuffle.
    """
    columns = target.columns
    lost = _any_null(keys)
    salt = _salt(columns, keys)
    place = [*keys, "__salt"]
    copies = F.count(F.lit(1)).over(Window.partitionBy(*place))
    # The marks are columns of their own, so that NULL values update too.
    fresh = (
        source.select(*columns).withColumn("__salt", salt).withColumn("__copies", copies)
        # A filter, so that the check runs whatever columns are read.
        .filter(
            F.when(
                (F.col("__copies") > 1) & (F.col("__salt") == 0) & ~lost,
                F.raise_error(F.lit("more than one source row for a key")).cast("boolean"),
            ).otherwise(F.lit(True))
        )
        .withColumn("__new", F.lit(True)).drop("__copies").alias("s")
    )
    old = target.withColumn("__salt", salt).alias("t")
    match = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in place])
    return old.join(fresh, match, "full_outer").select(*[
        F.when(F.col("s.__new"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        for c in columns
    ])
