"""Exact duplicates by deterministic block naming.

A text is cut into fixed-size byte blocks. The distinct blocks are sorted and
named by their places, so equal blocks and only those share a name. Adjacent
names are then paired and the distinct pairs named in the same way, level by
level, until one name is left per document. Texts are identical exactly when
both the level and the name are; no hash decides between documents. Rows
that repeat one id with different texts are told apart by a 64-bit hash of
the text (with the SHA-256 kept beside it), which two different texts of the
same id could share.

Block texts are shuffled once, combined before the shuffle. Documents find
the name of a block by its 64-bit key; blocks that share a key with a
different block are looked up by their whole content instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import settled
from .common import let, table

BLOCK_BYTES = 4096


def _blocks(text: Column, size: int) -> Column:
    """The byte blocks of a text; NULL and empty texts have one empty block."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    return let(body, lambda b: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.octet_length(b) / size).cast("int")) - 1),
        lambda i: F.substring(b, i * size + 1, F.lit(size)),
    ))


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """``name``: the place of a row in the sorted order of its partition, partitions apart."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_names(
    documents: DataFrame, id_col: str, text_col: str, size: int, key: Callable[[Column], Column]
) -> tuple[DataFrame, DataFrame]:
    """One row per document text with its block keys, and one row per block place with its name."""
    docs = settled(
        documents.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha"),
            F.transform(_blocks(F.col(text_col), size), lambda b: key(b)).alias("keys"),
        )
        .groupBy("doc_id", "text_key")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.first("sha").alias("sha"), F.first("keys").alias("keys"))
    )
    blocks = documents.select(F.explode(_blocks(F.col(text_col), size)).alias("block"))
    names = settled(_named(blocks.distinct(), ["block"]).select(key(F.col("block")).alias("key"), "name"))
    clashing = names.groupBy("key").count().filter("count > 1").select("key")
    places = docs.select("doc_id", "text_key", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    if clashing.isEmpty():
        return docs, places.join(names, "key").drop("key")
    clashing = settled(clashing)
    whole = documents.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        F.posexplode(_blocks(F.col(text_col), size)).alias("pos", "block"),
    ).withColumn("key", key(F.col("block"))).join(clashing, "key", "left_semi")
    spare = settled(_named(whole.select("block").distinct(), ["block"]).withColumn("name", -1 - F.col("name")))
    exact = whole.distinct().join(spare, "block").select("doc_id", "text_key", "pos", "name")
    sizes = docs.select("doc_id", "text_key", F.size("keys").alias("n"))
    same = exact["doc_id"].eqNullSafe(sizes["doc_id"]) & (exact["text_key"] == sizes["text_key"])
    exact = exact.join(sizes, same).select(sizes["doc_id"], sizes["text_key"], "n", "pos", "name")
    plain = places.join(clashing, "key", "left_anti").join(names, "key").drop("key")
    return docs, plain.unionByName(exact)


def identities(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
    key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per (id, text): ``doc_id, text_key, n_rows, sha, level, name``.

    ``level`` and ``name`` are equal for equal texts and for no others.
    """
    docs, places = block_names(documents, id_col, text_col, block_bytes, key)
    current, done, level = settled(places), [], 0
    while True:
        done.append(current.filter("n = 1").select("doc_id", "text_key", F.lit(level).alias("level"), "name"))
        rest = current.filter("n > 1")
        if rest.isEmpty():
            break
        pairs = rest.groupBy("doc_id", "text_key", "n", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.struct("name"))).alias("right"),
        )
        pairs = settled(pairs.select(
            "doc_id", "text_key", F.shiftright(F.col("n") + 1, 1).alias("n"), "pos", "left",
            F.col("right").isNull().alias("alone"), F.coalesce(F.col("right.name"), F.lit(0)).alias("right"),
        ))
        keys = ["left", "alone", "right"]
        names = settled(_named(pairs.select(*keys).distinct(), keys))
        current = settled(pairs.join(names, keys).drop(*keys))
        level += 1
    found = reduce(DataFrame.unionByName, done)
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (docs["text_key"] == found["text_key"])
    return docs.join(found, same).select(
        docs["doc_id"], docs["text_key"], "n_rows", "sha", "level", "name"
    )


def exact_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. NULL texts count as
    empty. NULL ids lose against any other; in a group of NULL ids only,
    ``keep_id`` is NULL and one row stays. Of repeated rows (id and text
    equal) one stays and all count. An empty table gives no rows; other
    columns are ignored.
    """
    named = settled(identities(documents, id_col, text_col, block_bytes))
    groups = settled(named.groupBy("level", "name").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size")
    ))
    return (
        named.join(groups, ["level", "name"])
        .select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("nth"))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates over all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}

ORACLES = {"op6_exact_dedup": """
with t as (select doc_id, coalesce(text, '') as body from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(body) as text_sha256
from t window same as (partition by body)
"""}
