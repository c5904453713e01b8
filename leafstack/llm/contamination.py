"""Benchmark decontamination by winnowing, in column functions and joins only.

Documents are hashed by runs of ``GRAM`` words; of every ``WINDOW - GRAM + 1``
consecutive hashes the least is kept (the leftmost in a tie). Two equal runs of
``WINDOW`` words keep the same one, so every shared window is found through
its kept hash. The benchmark's distinct windows carry their kept hash and its
place. Documents' kept hashes are joined with them, and each hit is extended:
the document's words around the hash must equal the window, word by word.

Items of fewer words are one shorter window. For each such length that the
benchmark has, all runs of that length are joined (winnowing with a window of
one hash).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import settled
from .common import let, table
from .spans import SEGMENT, count_words, segments, starts, words

WINDOW = 10
GRAM = 5
#: Up to so many benchmark windows (some 200 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000
#: Up to so many distinct kept hashes of the benchmark, documents' others are left out before they become rows.
FILTER_HASHES = 20_000
_PLACES = 1023


def _hashes(words_: Column, gram: int) -> Column:
    """The hash of every run of ``gram`` words, its place in the low ten bits."""
    hashed = F.transform(words_, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - gram),
        lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(gram)]).bitwiseAND(F.lit(~_PLACES)).bitwiseOR(i.cast("bigint")),
    ))


def kept_hashes(words_: Column, window: int, gram: int) -> Column:
    """The kept hashes of a segment, each once, places in the low ten bits."""
    width = window - gram + 1
    kept = let(_hashes(words_, gram), lambda h: F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(h) - width), lambda i: F.array_min(F.slice(h, i + 1, width))
    )))
    return F.when(F.size(words_) >= window, kept).otherwise(F.array().cast("array<bigint>"))


def _benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``item_id, run``: the windows of every item, each once."""
    whole = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("words"))
    short = whole.filter((F.size("words") > 0) & (F.size("words") < window)).select("item_id", F.col("words").alias("run"))
    long = segments(benchmark, [F.col(item_col).cast("string").alias("item_id")], F.col(text_col), window - 1)
    runs = F.explode(F.transform(starts(F.col("words"), window), lambda i: F.slice(F.col("words"), i + 1, window)))
    return short.unionByName(long.select("item_id", runs.alias("run"))).distinct()


def occurrences(
    documents: DataFrame, runs: DataFrame, id_col: str, text_col: str, window: int, gram: int, lengths: list[int], few: bool
) -> DataFrame:
    """``doc_id, text_key, start, run_id, length``: the places where a window stands in a document."""
    keys = [F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key")]
    side = F.broadcast if few else lambda df: df
    before, found = window - gram, []
    if window in lengths:
        full = runs.filter(F.size("run") == window).select(
            "run_id", "run", F.array_min(_hashes(F.col("run"), gram)).alias("kept")
        ).select("run_id", "run", F.col("kept").bitwiseAND(F.lit(~_PLACES)).alias("hash"),
                 F.col("kept").bitwiseAND(F.lit(_PLACES)).cast("int").alias("place"))
        rows = segments(documents, keys, F.col(text_col), window - 1)
        rows = rows.withColumn("hashes", kept_hashes(F.col("words"), window, gram))
        wanted = full.select("hash").distinct().limit(FILTER_HASHES + 1).toArrow().column("hash").to_pylist()
        if len(wanted) <= FILTER_HASHES:
            listed = ", ".join(f"{h}L" for h in sorted(wanted))
            rows = rows.withColumn("hashes", F.expr(f"filter(hashes, k -> (k & {~_PLACES}L) in ({listed}))"))
        hits = rows.select("doc_id", "text_key", "first", F.explode(let(F.col("words"), lambda w: F.transform(
            F.col("hashes"),
            lambda k: let(k.bitwiseAND(F.lit(_PLACES)).cast("int"), lambda p: F.struct(
                k.bitwiseAND(F.lit(~_PLACES)).alias("hash"), p.alias("at"),
                # the words around the hash, and how many of them stand before it
                F.slice(w, F.greatest(F.lit(1), p - before + 1), window + before).alias("near"),
                F.least(p, F.lit(before)).alias("lead"),
            )),
        ))).alias("kept"))
        hits = hits.select("doc_id", "text_key", "first", "kept.*")
        begin = F.col("lead") - F.col("place")
        same = (hits["hash"] == full["hash"]) & (begin >= 0) & (
            F.slice("near", F.greatest(F.lit(1), begin + 1), window) == F.col("run")
        )
        found.append(hits.join(side(full), same).select(
            "doc_id", "text_key", (F.col("first") + F.col("at") - F.col("place")).alias("start"), "run_id", F.lit(window).alias("length")
        ))
    for length in lengths:
        if length == window:
            continue
        short = runs.filter(F.size("run") == length).select("run_id", F.array_join("run", " ").alias("text"))
        rows = segments(documents, keys, F.col(text_col), length - 1)
        texts = F.transform(starts(F.col("words"), length), lambda i: F.struct(
            i.alias("at"), F.array_join(F.slice("words", i + 1, length), " ").alias("text")
        ))
        grams = rows.select("doc_id", "text_key", "first", F.explode(texts).alias("g"))
        grams = grams.select("doc_id", "text_key", (F.col("first") + F.col("g.at")).alias("start"), F.col("g.text").alias("text"))
        found.append(grams.join(side(short), "text").select("doc_id", "text_key", "start", "run_id", F.lit(length).alias("length")))
    return reduce(DataFrame.unionByName, found)


def _hits(documents, benchmark, id_col, text_col, item_col, item_text_col, window, gram):
    """The items' windows, the distinct ones, whether these are few, and their places in documents (None without any)."""
    if window - gram < 1 or SEGMENT + window > _PLACES:
        raise ValueError("a window must be longer than a gram and a segment below 1023 words")
    of_items = settled(_benchmark_windows(benchmark, item_col, item_text_col, window))
    runs = settled(of_items.select("run").distinct().withColumn("run_id", F.monotonically_increasing_id()))
    lengths = {r["n"]: r["count"] for r in runs.groupBy(F.size("run").alias("n")).count().collect()}
    few = sum(lengths.values()) <= BROADCAST_WINDOWS
    if not lengths:
        return of_items, runs, few, None
    found = occurrences(documents, runs, id_col, text_col, window, gram, sorted(lengths), few)
    return of_items, runs, few, settled(found.distinct())


def clean_documents(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """The rows of ``documents`` without a window of the benchmark, with all columns.

    NULL and empty texts have no words and stay. Repeated rows stay or leave
    together. An empty benchmark keeps every row; an empty table gives an
    empty table. Other columns are carried as they are.
    """
    _, _, _, hits = _hits(documents, benchmark, id_col, text_col, item_col, item_text_col, window, gram)
    if hits is None:
        return documents
    found = hits.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    rows = documents.select(F.struct("*").alias("row"), F.col(id_col).alias("__doc"), F.xxhash64(text_col).alias("__text"))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    return rows.join(found, same, "left_anti").select("row.*")


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    NULL and empty texts have no words and are clean. Items without words have
    no window; items of one id count as one item; NULL item ids find windows
    but name no item. Repeated rows come out alike, as often as they come.
    An empty table gives no rows, an empty benchmark clean ones; other columns
    are ignored.
    """
    of_items, runs, few, hits = _hits(documents, benchmark, id_col, text_col, item_col, item_text_col, window, gram)
    keys = ["doc_id", "text_key"]
    counted = documents.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), count_words(F.col(text_col)).alias("n_words")
    )
    if hits is None:
        return counted.select(
            "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"),
            F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"),
        )
    end = F.col("start") + F.col("length")
    covered = F.max(end).over(
        Window.partitionBy(*keys).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    )
    places = hits.select(*keys, "start", "length").distinct().withColumn("covered", covered)
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.col("covered"), F.lit(0))))
    n_hit = places.groupBy(*keys).agg(F.sum(new).alias("n_hit"))
    named = settled(of_items.filter("item_id is not null").join(runs, "run").select("run_id", "item_id"))
    small = few and named.count() <= BROADCAST_WINDOWS
    items = hits.select(*keys, "run_id").distinct().join(F.broadcast(named) if small else named, "run_id").groupBy(*keys).agg(
        F.collect_set("item_id").alias("items")
    )
    result = n_hit.join(items, n_hit["doc_id"].eqNullSafe(items["doc_id"]) & (n_hit["text_key"] == items["text_key"]), "left")
    result = result.select(
        n_hit["doc_id"].alias("hit_doc"), n_hit["text_key"].alias("hit_key"), "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.coalesce("items", F.array().cast("array<string>"))), ","), 256).alias("items_sha256"),
    )
    return counted.join(result, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: windows of ten words."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}

ORACLES = {"op7_decontaminate": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as run
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), lengths as (select distinct n from bw), dw as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as run
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lengths where len(w) >= n)
), hit as (select distinct dw.doc_id, dw.i, dw.n from dw where run in (select run from bw)),
words_hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
  from (select distinct dw.doc_id, bw.item_id::varchar as item_id from dw join bw using (run)) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words_hit using (doc_id) left join items using (doc_id)
"""}
