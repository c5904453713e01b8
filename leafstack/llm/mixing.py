"""Mixing sources to target weights by Pareto order sampling.

A source's target is a share of a fixed number of words, bounded by a multiple
of the source's size. A document's expected copies are the target over the
size of its source, times its weight where one is given. The whole part is
certain. The fraction is an inclusion probability p: with a uniform number u
per document, documents are ranked by (u / (1 - u)) / (p / (1 - p)), and the
first ones are taken until the source's remaining words are reached.

The rank is never computed by sorting a source. The place where the words are
reached is found by binning: sums per source and bin, then finer bins inside
the bin that crosses, so that one source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..operators.skew import number_rows
from ..session import settled
from .common import table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BINS = 4096
FINE_ROWS = 10_000
ROUNDS = 4
#: Up to so many sources, a table with a row per source is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def _sent(per_source: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(per_source) if few else per_source


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """Add ``target`` to one row per source (``source, is_null, source_size``).

    Sources in code point order, NULL last, take the weights in turn. What a
    source may not take beyond ``most`` times its size is shared again by
    weight. The driver sees sums only.
    """
    numbered = number_rows(sources, ["is_null", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    numbered = settled(numbered.select("source", "is_null", "source_size", weight.cast("double").alias("weight")))
    cap = F.col("source_size") * most
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    above, level = F.lit(False), None
    full = (-1, 0)
    while True:
        rest = numbered.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if rest["n"] == full[0] or not rest["weight"]:
            break
        full = (rest["n"], 0)
        level = (total * share - rest["words"], rest["weight"])
        above = above | (F.col("weight") * level[0] / level[1] > cap)
    if level is None:
        return numbered.withColumn("target", F.lit(0.0))
    fair = F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1]))
    return numbered.withColumn("target", F.when(above, cap.cast("double")).otherwise(fair))


def _cuts(docs: DataFrame, need: DataFrame, few: bool) -> DataFrame:
    """``source, is_null, cut``: documents with a lower ``order`` than the cut are taken.

    ``docs`` has ``source, is_null, size, order`` (0 to 1), ``need`` the words
    wanted per source. Among documents of one order all are taken or none.
    """
    keys = ["source", "is_null"]
    open_ = need.select(*keys, "need", F.lit(0.0).alias("low"), F.lit(1.0).alias("width"))
    for step in range(ROUNDS + 1):
        inside = docs.join(_sent(open_, few), keys).filter((F.col("order") >= F.col("low")) & (F.col("order") < F.col("low") + F.col("width")))
        last = step == ROUNDS or step and inside.groupBy(*keys).count().filter(F.col("count") > FINE_ROWS).isEmpty()
        place = F.col("order") if last else F.floor((F.col("order") - F.col("low")) / F.col("width") * BINS)
        sums = inside.groupBy(*keys, "need", "low", "width", place.alias("place")).agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy(*keys).orderBy("place")) - F.col("words")
        sums = sums.withColumn("before", before)
        if last:
            past = F.when(F.col("before") + F.col("words") / 2 > F.col("need"), F.col("place"))
            return sums.groupBy(*keys).agg(F.coalesce(F.min(past), F.max(F.col("low") + F.col("width"))).alias("cut"))
        crossing = sums.filter(
            (F.col("before") <= F.col("need")) & (F.col("before") + F.col("words") > F.col("need"))
        )
        open_ = settled(crossing.groupBy(*keys).agg(
            F.min(F.struct("place", "before", "need", "low", "width")).alias("x")
        ).select(
            *keys, (F.col("x.need") - F.col("x.before")).alias("need"),
            (F.col("x.low") + F.col("x.place") * F.col("x.width") / BINS).alias("low"),
            (F.col("x.width") / BINS).alias("width"),
        ))


def _drawn(documents: DataFrame, id_col, text_col, source_col, weight_col, seed, *passed: Column) -> DataFrame:
    """The columns ``passed`` with ``source, is_null, size, doc_weight`` and the uniform number ``u`` of a document."""
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    text_id = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    ticket = F.conv(F.substring(F.md5(text_id.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return documents.select(
        *passed, F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(source_col).isNull().alias("is_null"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
        weight.alias("doc_weight"), ((ticket + 0.5) / 2.0**52).alias("u"),
    )


def _ranked(docs: DataFrame, per_source: DataFrame, few: bool, most: int) -> DataFrame:
    """Add the certain copies, the chance ``p`` of one more and, where there is one, the rank ``order``."""
    expected = F.least(F.lit(float(most)), F.col("scale") * F.col("doc_weight"))
    odds = F.col("u") * (1 - F.col("p"))
    return (
        docs.join(_sent(per_source, few), ["source", "is_null"])
        .withColumn("expected", expected).withColumn("certain", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("certain"))
        .withColumn("order", F.when(F.col("p") > 0, odds / (odds + (1 - F.col("u")) * F.col("p"))))
    )


def _copies() -> Column:
    extra = F.when(F.col("p") > 0, (F.col("order") < F.coalesce(F.col("cut"), F.lit(2.0))).cast("bigint"))
    return F.col("certain") + F.coalesce(extra, F.lit(0))


def source_plan(docs: DataFrame, weights, share: float, most: int) -> tuple[DataFrame, bool]:
    """A row per source with ``source_size, target, scale, cut``, and whether these are few enough to broadcast."""
    keys = ["source", "is_null"]
    sources = settled(targets(
        docs.groupBy(*keys).agg(F.sum("size").alias("source_size")), weights, share, most
    ))
    few = sources.count() <= BROADCAST_SOURCES
    scales = settled(_scales(docs, sources, most, few))
    ranked = _ranked(docs, scales, few, most)
    need = ranked.groupBy(*keys).agg(
        F.max("target").alias("target"), F.sum(F.col("certain") * F.col("size")).alias("words")
    ).select(*keys, (F.col("target") - F.col("words")).alias("need"))
    cuts = _cuts(ranked.filter("p > 0 and size > 0").select(*keys, "size", "order"), settled(need), few)
    return settled(scales.join(cuts, keys, "left")), few


def mix(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weight_col: str | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = 7,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, copies, taken``.

    ``size`` counts the words of a text, 0 for NULL. ``weight_col`` (positive
    numbers) makes the expected copies within a source unequal; without it all
    documents of a source have the same. NULL sources are one source. Repeated
    rows have the same random number and are taken alike. Without words all
    targets are 0. An empty table gives no rows; other columns are ignored.
    """
    docs = settled(_drawn(documents, id_col, text_col, source_col, weight_col, seed, F.col(id_col).alias("doc_id")))
    plan, few = source_plan(docs, weights, share, most)
    return _ranked(docs, plan, few, most).withColumn("copies", _copies()).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weight_col: str | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = 7,
) -> DataFrame:
    """The rows of the mix with all columns, each as often as it is taken.

    A NULL text has size 0 and adds no words. Repeated rows are drawn as
    separate rows; a NULL source is a source of its own, ordered last. The
    draw depends on ``seed`` and the ids only, so reruns agree. An empty table
    gives no rows. Other columns are carried with every copy.
    """
    sizes = settled(_drawn(documents, id_col, text_col, source_col, weight_col, seed))
    plan, few = source_plan(sizes, weights, share, most)
    rows = _drawn(documents, id_col, text_col, source_col, weight_col, seed, F.struct("*").alias("row"))
    rows = _ranked(rows, plan, few, most).withColumn("copies", _copies().cast("int"))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def _scales(docs: DataFrame, sources: DataFrame, most: int, few: bool) -> DataFrame:
    """Add ``scale``: expected copies per unit of document weight, so that a source's words meet its target."""
    keys = ["source", "is_null"]
    scales, full = sources.withColumn("scale", F.lit(0.0)), -1
    while True:
        capped = F.col("scale") * F.col("doc_weight") >= most
        sums = docs.join(_sent(scales, few), keys).groupBy(*keys, "source_size", "target").agg(
            F.coalesce(F.sum(F.when(capped, F.col("size") * most)), F.lit(0)).alias("whole"),
            F.sum(F.when(~capped, F.col("size") * F.col("doc_weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"), F.max("scale").alias("old"),
        )
        scales = settled(sums.select(
            *keys, "source_size", "target", "n",
            F.when(F.col("open") > 0, (F.col("target") - F.col("whole")) / F.col("open")).otherwise(F.col("old")).alias("scale"),
        ))
        n = scales.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if n == full:
            return scales.drop("n")
        full, scales = n, scales.drop("n")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sources weigh 5, 2, 1 in turn, 150 % of all words, at most two copies."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mix_sources": op8_mix_sources}

ORACLES = {"op8_mix_sources": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (('0x' || substr(md5(concat('7:', coalesce(doc_id::varchar, 'null'))), 1, 13))::bigint + 0.5) / pow(2.0, 52) as u
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
  from d group by source
), w as (
  select *, sum(source_size) over () * 1.5 as total, sum(weight) over () as weights,
         coalesce(sum(2 * source_size) over below, 0) as words_below, coalesce(sum(weight) over below, 0) as weight_below
  from s window below as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), c as (
  select *, weight * (total - words_below)::double / (weights - weight_below)::double > 2 * source_size as above from w
), t as (
  select source, source_size, case when above then (2 * source_size)::double
    else weight * (total - sum(case when above then 2 * source_size else 0 end) over ())::double
      / (sum(case when above then 0 else weight end) over ())::double end as target from c
), e as (
  select d.*, t.source_size, t.target, least(2.0, case when t.source_size > 0 then t.target / t.source_size else 0 end) as expected
  from d join t on d.source is not distinct from t.source
), p as (
  select *, floor(expected) as certain, expected - floor(expected) as p from e
), o as (
  select *, case when p > 0 then u * (1 - p) / (u * (1 - p) + (1 - u) * p) end as ord,
         target - sum(certain * size) over (partition by source) as need from p
), r as (
  select *, coalesce(sum(size) over (partition by source order by ord nulls last, doc_id
                                     rows between unbounded preceding and 1 preceding), 0) as before from o
)
select doc_id, size, source_size, target,
       (size * (certain + case when p > 0 and before + size / 2 <= need then 1 else 0 end))::bigint as taken from r
"""}
