"""Scans, views, catalog tables, set operators and table changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from ..operators import changes, windows
from ..operators.documents import assign_ids, chunk_windows, embed, page_chunks
from ..operators.joins import lookup
from ..schemas import CHUNKS, PARTS
from ..session import scratch_path
from ..sources import (
    ensure_chunks, ensure_parts, ensure_schema, from_rows, load, qualified, spread, view,
)
from . import fixtures as fx


def a4_schema(spark, sf):
    """A table in a schema of its own; the current schema is set back after."""
    before = spark.catalog.currentDatabase()
    schema = f"manuals_{uuid.uuid4().hex}"
    try:
        ensure_schema(spark, f"`{schema}`", scratch_path(spark, "schema"))
        ensure_schema(spark, schema)
        load(spark, sf, "documents").groupBy("source").agg(
            F.count(F.lit(1)).alias("documents")
        ).write.saveAsTable("sources")
    finally:
        spark.catalog.setCurrentDatabase(before)
    return spark.table(qualified(f"{schema}.sources"))


def a5_chunk_table(spark, sf):
    """Create the chunk table, fill it from the manuals and read it back."""
    name = f"chunks_{uuid.uuid4().hex}"
    ensure_chunks(spark, name, scratch_path(spark, "chunks"))
    rows = assign_ids(page_chunks(fx.manual_files(spark, sf)), ["path", "page_number", "chunk_no"])
    embed(rows).select(*CHUNKS.fieldNames()).write.insertInto(name)
    return spark.table(qualified(name)).select(
        "path", "title", "url", "page_number", F.length("content").cast("bigint").alias("n_chars"),
        F.size("embedding").cast("bigint").alias("width"),
    )


def a6_part_table(spark, sf):
    """Create the part-list table, fill it and read it back."""
    name = f"parts_{uuid.uuid4().hex}"
    ensure_parts(spark, name, scratch_path(spark, "parts"))
    fx.part_lists(spark, sf).select(*PARTS.fieldNames()).write.insertInto(name)
    return spark.table(qualified(name))


def a7_scan(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")


def a8_view(spark, sf):
    view(load(spark, sf, "documents"), "documents_view")
    return spark.sql(
        "select lang, count(*) as documents, sum(n_chars) as n_chars from documents_view group by lang"
    )


def a9_from_rows(spark, sf):
    """Rows made on the driver, joined to a table."""
    names = from_rows(
        spark, [("en", "English"), ("fr", "French"), ("de", "German"), ("es", "Spanish")],
        T.StructType([T.StructField("lang", T.StringType()), T.StructField("name", T.StringType())]),
    )
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(names, "lang", "left").select("doc_id", "name")


def b9_ids(spark, sf):
    docs = spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    rows = chunk_windows(docs)
    return assign_ids(rows.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"]).select(
        "id", "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no")
    )


def d4_lookup(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    features = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return lookup(orders, features, "o_custkey", "c_custkey")


def e1_latest(spark, sf):
    events = load(spark, sf, "events")
    return windows.latest_per_key(
        events.select("user_id", "event_id", "ts", "event_type"), ["user_id"],
        [F.col("ts").desc(), F.col("event_id").desc()],
    )


def e4_union(spark, sf):
    d = load(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    c = load(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    b = load(spark, sf, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    rows = d.unionByName(c).unionByName(b)
    return rows.select("kind", "id", F.md5("text").alias("digest"))


def _snapshots(spark, sf):
    """Two versions of the part table: sizes come and go, one type changes price."""
    part = load(spark, sf, "part")
    row = [F.col("p_partkey").alias("k"), F.col("p_name").alias("n")]
    old = part.filter(F.col("p_size") != 7).select(*row, F.col("p_retailprice").alias("v"))
    price = F.when(F.col("p_type") == "ECONOMY", F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    new = part.filter(F.col("p_size") != 11).select(*row, price.alias("v"))
    return old, new


_SNAPSHOTS = """old as (select p_partkey as k, p_name as n, p_retailprice as v from part where p_size <> 7),
new as (select p_partkey as k, p_name as n,
    case when p_type = 'ECONOMY' then p_retailprice + 1 else p_retailprice end as v from part where p_size <> 11)"""


def e5_change_feed(spark, sf):
    return changes.change_feed(*_snapshots(spark, sf), ["k"])


def e6_sync_index(spark, sf):
    old, new = _snapshots(spark, sf)
    created = changes.sync_index(None, changes.change_feed(old.limit(0), old, ["k"]), ["k"])
    return changes.sync_index(created, changes.change_feed(old, new, ["k"]), ["k"])


def e7_latest_version(spark, sf):
    rows = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("name"), F.col("o_orderkey").cast("string").alias("version")
    )
    return windows.latest_version(rows)


def e8_distinct(spark, sf):
    return load(spark, sf, "documents").select("source", "lang").distinct()


def e8_limit(spark, sf):
    return load(spark, sf, "documents").orderBy("doc_id").limit(10).select("doc_id", "source", "n_chars")


def h8_json_decode(spark, sf):
    props = F.from_json("props", "k bigint")
    return load(spark, sf, "events").select("event_id", props["k"].alias("k"))


QUERIES = {f.__name__: f for f in (
    a4_schema, a5_chunk_table, a6_part_table, a7_scan, a8_view, a9_from_rows, b9_ids, d4_lookup, e1_latest, e4_union,
    e5_change_feed, e6_sync_index, e7_latest_version, e8_distinct, e8_limit, h8_json_decode,
)}

ORACLES = {
    "a4_schema": "select source, count(*) as documents from documents group by source",
    "a9_from_rows": """select doc_id, case lang when 'en' then 'English' when 'fr' then 'French'
  when 'de' then 'German' when 'es' then 'Spanish' end as name from documents""",
    "a5_chunk_table": fx.with_ctes(
        "select path, title, url, page_number::int as page_number, length(text) as n_chars, 64::bigint as width from manuals",
        fx.MANUALS,
    ),
    "a6_part_table": fx.with_ctes(
        "select item_number, part_number, designation, part_code, part_name, qr_code_url from part_lists",
        fx.PART_LISTS,
    ),
    "a7_scan": "select doc_id, source, lang, n_chars from documents",
    "a8_view": "select lang, count(*) as documents, sum(n_chars)::bigint as n_chars from documents group by lang",
    "b9_ids": """with w as (select doc_id, len([x for x in regexp_split_to_array(text, '\\s+') if x <> '']) as n from documents),
s as (select doc_id, n, unnest(range(0, greatest(n - 11, 0) + 1, 490)) as st from w)
select row_number() over (order by doc_id, st) as id, doc_id, st // 490 as chunk_no from s where n > 0""",
    "d4_lookup": """select o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_acctbal
from orders left join customer on o_custkey = c_custkey""",
    "e1_latest": """select user_id, event_id, ts, event_type from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
  from events) where rn = 1""",
    "e4_union": """select 'document' as kind, doc_id as id, md5(text) as digest from documents
union all select 'turn', conv_id * 1000 + turn, md5(text) from conversations
union all select 'item', item_id, md5(text) from benchmark""",
    "e5_change_feed": fx.with_ctes(
        """select case when o.k is null then 'insert' else 'delete' end as change, coalesce(o.k, n.k) as k,
  coalesce(o.n, n.n) as n, coalesce(o.v, n.v) as v
from old o full join new n on o.k = n.k where o.k is null or n.k is null
union all select 'update_pre', o.k, o.n, o.v from old o join new n on o.k = n.k
  where o.n is distinct from n.n or o.v is distinct from n.v
union all select 'update_post', n.k, n.n, n.v from old o join new n on o.k = n.k
  where o.n is distinct from n.n or o.v is distinct from n.v""",
        _SNAPSHOTS,
    ),
    "e6_sync_index": fx.with_ctes("select k, n, v from new", _SNAPSHOTS),
    "e7_latest_version": """select o_custkey as name, max(o_orderkey)::varchar as version from orders group by o_custkey""",
    "e8_distinct": "select distinct source, lang from documents",
    "e8_limit": "select doc_id, source, n_chars from documents order by doc_id limit 10",
    "h8_json_decode": "select event_id, (props->>'k')::bigint as k from events",
}
