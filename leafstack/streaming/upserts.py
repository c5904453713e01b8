"""A stream of pages merged into a versioned part list.

The table at ``root`` is cut into buckets by the first key. A version holds
only the buckets its batch touched, so the cost of a batch grows with what it
touches and not with the table. The table is, for each bucket, the directory
of its newest complete version:
``root/buckets=64/version=7/stream=1/batch=4/bucket=3``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.joins import replace_by_key
from ..operators.parts import PART_KEYS, extract_listing
from ..schemas import PARTS
from ..session import settled
from ..sources.paths import delete, levels, stream_number

# For a small table. A large one wants buckets of about a gigabyte.
BUCKETS = 64


def _base(spark: SparkSession, root: str, buckets: int | None = None) -> str:
    """The folder of the versions; an error if the table has another number of buckets."""
    found = [d["buckets"] for d in levels(spark, f"{root}/buckets=*")]
    if found and buckets not in (None, *found):
        raise ValueError(f"the table has {found[0]} buckets, not {buckets}")
    return f"{root}/buckets={found[0] if found else buckets or BUCKETS}"


def _folder(base: str, version, stream, batch) -> str:
    return f"{base}/version={version}/stream={stream}/batch={batch}"


def _done(spark: SparkSession, base: str) -> dict[int, tuple[int, int]]:
    """Complete versions with the stream and batch that wrote them.

    Spark adds the success mark last.
    """
    marks = levels(spark, _folder(base, "*", "*", "*") + "/_SUCCESS")
    return {d["version"]: (d["stream"], d["batch"]) for d in marks}


def _held(spark: SparkSession, base: str) -> dict[int, list[int]]:
    """The complete versions of each bucket, oldest first."""
    done, held = _done(spark, base), {}
    for d in levels(spark, _folder(base, "*", "*", "*") + "/bucket=*"):
        if done.get(d["version"]) == (d["stream"], d["batch"]):
            held.setdefault(d["bucket"], []).append(d["version"])
    return {b: sorted(versions) for b, versions in held.items()}


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def committed_version(spark: SparkSession, root: str) -> int | None:
    return max(_done(spark, _base(spark, root)), default=None)


def write_version(
    df: DataFrame, root: str, version: int, key: str, buckets: int = BUCKETS,
    stream: int = 0, batch: int = 0,
) -> None:
    """Write rows as the given version of their buckets.

    The rebalance gives a bucket few files, and AQE splits a hot one.
    """
    rows = df.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
    folder = _folder(_base(df.sparkSession, root, buckets), version, stream, batch)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_version(
    spark: SparkSession, root: str, schema: StructType, buckets: Iterable[int] | None = None
) -> DataFrame:
    """The newest table, or some of its buckets; no rows if nothing is complete."""
    base = _base(spark, root)
    done, held = _done(spark, base), _held(spark, base)
    paths = [
        f"{_folder(base, held[b][-1], *done[held[b][-1]])}/bucket={b}"
        for b in (held if buckets is None else buckets) if b in held
    ]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def expire_versions(spark: SparkSession, root: str, keep: int) -> int:
    """Delete what is not among the ``keep`` newest complete versions of its bucket."""
    base = _base(spark, root)
    done = _done(spark, base)
    old = [(b, v) for b, versions in _held(spark, base).items() for v in versions[:-keep]]
    for bucket, version in old:
        delete(spark, f"{_folder(base, version, *done[version])}/bucket={bucket}")
    # A version none of whose buckets is left goes whole, so that listings do not grow.
    held = {v for versions in _held(spark, base).values() for v in versions}
    for version in sorted(done)[:-1]:
        if version not in held:
            delete(spark, f"{base}/version={version}")
    return len(old)


def upsert_stream(
    pages: DataFrame, root: str, checkpoint: str, keys: list[str] = PART_KEYS,
    extract: Callable[[DataFrame], DataFrame] = extract_listing, schema: StructType = PARTS,
    keep: int = 2, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Merge what ``extract`` finds in each micro-batch into the table at ``root``.

    A batch reads the buckets it touches and writes them as the next version.
    All rows that it has for a key take the place of the table's rows for it,
    so pages that share their keys should come in one batch. If its version is
    complete, a repeated batch does nothing; if it was cut off, it is replaced.
    ``keep`` versions of a bucket stay, for readers.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _done(spark, _base(spark, root, buckets))
        stream = stream_number(spark, checkpoint)
        if (stream, batch_id) in done.values():
            return
        source = settled(extract(batch))
        touched = source.select(bucket_of(keys[0], buckets).alias("b")).distinct().collect()
        target = read_version(spark, root, schema, [r["b"] for r in touched])
        version = max(done, default=-1) + 1
        write_version(
            replace_by_key(target, source, keys), root, version, keys[0], buckets, stream, batch_id
        )
        expire_versions(spark, root, max(keep, 2))

    query = (
        pages.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).foreachBatch(merge).start()
    )
    query.awaitTermination()
    return query
