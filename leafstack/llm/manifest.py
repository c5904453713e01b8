"""A Merkle manifest of a table by nested-struct rollup.

Every row is a leaf: the SHA-256 of its fields, each written as ``-`` when
NULL, else as its UTF-8 byte count, ``:`` and the value (integers decimal).
Within a group (a language) leaves stand in the order of their ids; while a
group has several nodes, every ``FAN`` consecutive nodes (the last run fewer,
even one) become the hash of their hex digests, concatenated. The last node
of a group is its subroot. The subroots, ordered by group (NULL first,
UTF-8 bytewise), are folded the same way into the root.

How it runs: one global sort numbers the leaves of each group from 0 (ranks
are offsets of sorted partitions, so a group of any size is numbered by all
tasks). A rank's base-``FAN`` digits are then grouped away one level at a
time: grouping by ``rank >> 3`` collects at most ``FAN`` child structs, and
each child carries the entries (leaf and path so far) below it, extended by
its siblings on that level. A block of ``BLOCK_LEVELS`` levels nests at most
``FAN ** BLOCK_LEVELS`` entries into one row, so no row and no group is
unbounded; blocks are written to the checkpoint folder, and the next block
starts from their digests. Paths are completed top-down by joining a block's
rows to the exploded entries of the block above on (group, rank), a key
unique per row; a final transform and explode emits every leaf's proof
without a join per level. Group roots reach the leaves by a join salted over
the shuffle partitions, so a group with a third of all rows is still spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import settled
from .common import table

#: Children per node and levels nested into one row.
FAN = 8
BLOCK_LEVELS = 2
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for NULL, else ``<UTF-8 bytes>:<value>``."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def ranked(nodes: DataFrame, group: Column, order: list[Column]) -> DataFrame:
    """``g`` (the group), ``i`` (place in the group from 0) and ``n`` (nodes in the group) added.

    One global sort; a partition's rows are numbered by their offset, which
    a table of one row per (partition, group) gives. No group meets in one task.
    """
    keyed = nodes.withColumn("g", group)
    done = settled(keyed.orderBy(F.col("g").asc_nulls_first(), *order).withColumn("_mid", F.monotonically_increasing_id()))
    part, local = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    bounds = done.groupBy(part.alias("_p"), "g").agg(F.count(F.lit(1)).alias("_c"), F.min(local).alias("_lo"))
    before = Window.orderBy("_p").rangeBetween(Window.unboundedPreceding, -1)
    bounds = bounds.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)) + F.col("_lo"))
    same = Window.partitionBy("g")
    bounds = bounds.select(
        "_p", F.col("g").alias("_g"),
        (F.col("_start") - F.col("_lo") - F.min("_start").over(same)).alias("_shift"),
        F.sum("_c").over(same).alias("n"),
    )
    joined = done.join(bounds, (part == F.col("_p")) & F.col("g").eqNullSafe(F.col("_g")))
    return joined.withColumn("i", local + F.col("_shift")).drop("_mid", "_p", "_g", "_shift")


def _level(nodes: DataFrame) -> DataFrame:
    """One level: every FAN nodes of a group with several become one; entries gain their siblings."""
    by_place = lambda a, b: F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)
    kids = nodes.groupBy("g", F.shiftright("i", 3).alias("_up")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "d", "entries")), by_place).alias("kids")
    ).withColumnRenamed("_up", "i")
    ds = lambda arr: F.concat_ws("", F.transform(arr, lambda k: k["d"]))
    return kids.select(
        "g", "i", F.ceil(F.col("n") / FAN).cast("long").alias("n"),
        F.sha2(ds(F.col("kids")), 256).alias("d"),
        F.flatten(F.transform("kids", lambda k, p: F.transform(k["entries"], lambda e: F.struct(
            e["item"].alias("item"),
            F.concat(e["path"], F.array(F.struct(
                ds(F.filter("kids", lambda _, j: j < p)).alias("left"),
                ds(F.filter("kids", lambda _, j: j > p)).alias("right"),
            ))).alias("path"),
        )))).alias("entries"),
    )


def rollup(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``g, i, n, d, item`` folded per group.

    Gives the entries with their paths up to the group's root (``g, item,
    path``) and the roots (``g, root``).
    """
    current = nodes.select("g", "i", "n", "d", F.array(F.struct(
        F.col("item").alias("item"), F.array().cast(PATH).alias("path"))).alias("entries"))
    blocks = []
    while True:
        for _ in range(BLOCK_LEVELS):
            current = _level(current.filter("n > 1")).unionByName(current.filter("n <= 1"))
        block = settled(current)
        blocks.append(block)
        if block.filter("n > 1").isEmpty():
            break
        current = block.filter("n > 1").select("g", "i", "n", "d", F.array(F.struct(
            F.struct("i").alias("item"), F.array().cast(PATH).alias("path"))).alias("entries"))
    roots = blocks[0].filter("n <= 1").select("g", F.col("d").alias("root"))
    for block in blocks[1:]:
        roots = roots.unionByName(block.filter("n <= 1").select("g", F.col("d").alias("root")))
    upper = None
    for block in reversed(blocks):
        rows = block.select("g", "i", "entries")
        if upper is not None:
            on = rows["g"].eqNullSafe(upper["ug"]) & (rows["i"] == upper["ui"])
            rows = rows.join(upper, on, "left").select("g", "i", F.transform(
                "entries", lambda e: F.struct(e["item"].alias("item"), F.concat(
                    e["path"], F.coalesce(F.col("up"), F.array().cast(PATH))).alias("path"))
            ).alias("entries"))
        if block is blocks[0]:
            return rows.select("g", F.explode("entries").alias("e")).select("g", "e.item", "e.path"), roots
        upper = rows.select(F.col("g").alias("ug"), F.explode("entries").alias("e")).select(
            "ug", F.col("e.item.i").alias("ui"), F.col("e.path").alias("up"))
    raise AssertionError("unreachable")


def manifest(
    documents: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``proof_sha256`` is the hash of the sibling digests, level by level up to
    the root, left to right (of an empty string for a table of one row).
    ``folded_root`` is the root recomputed from the row with its text
    tampered (A-Z lower-cased where 3 divides the unsigned crc32 of the
    decimal id; NULL texts and NULL ids stay) and the original siblings;
    ``verified`` says whether it equals ``root``.

    NULL ids stand before all others of their group; NULL groups come first.
    Repeated rows are separate leaves, ties in id are ordered by leaf (equal
    leaves are interchangeable). Empty and long texts are hashed whole. An
    empty table gives no rows; other columns are ignored.
    """
    doc = F.col(id_col)
    tamper = (F.crc32(doc.cast("string").cast("binary")) % 3 == 0) & F.col(text_col).isNotNull()
    changed = F.when(tamper, F.translate(F.col(text_col), UPPER, LOWER)).otherwise(F.col(text_col))
    rows = documents.select(
        doc.alias("_doc"), F.col(group_col).alias("_group"),
        leaf([F.col(c) for c in fields]).alias("d"),
        leaf([changed if c == text_col else F.col(c) for c in fields]).alias("_tampered"),
    )
    leaves = ranked(rows, F.col("_group"), [F.col("_doc").asc_nulls_first(), F.col("d")])
    entries, subroots = rollup(leaves.select("g", "i", "n", "d", F.struct(
        F.col("_doc").alias("doc_id"), F.col("d").alias("leaf"), "_tampered").alias("item")))
    subroots = settled(subroots)
    tops = ranked(subroots.select(F.col("g").alias("lang"), F.col("root").alias("d")), F.lit(0), [F.col("lang").asc_nulls_first()])
    top_entries, top_root = rollup(tops.select("g", "i", "n", "d", F.struct("lang", F.col("d").alias("subroot")).alias("item")))
    groups = settled(top_entries.join(top_root, "g").select(
        F.col("item.lang").alias("_lang"), F.col("item.subroot").alias("subroot"), F.col("path").alias("_top"), "root"))
    salts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = entries.withColumn("_salt", F.pmod(F.xxhash64("item.leaf", "item.doc_id"), F.lit(salts)))
    out = own.join(spread, own["g"].eqNullSafe(spread["_lang"]) & (own["_salt"] == spread["_salt"]))
    path = F.concat("path", "_top")
    fold = lambda start: F.aggregate(path, start, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))
    return out.select(
        F.col("item.doc_id").alias("doc_id"), F.col("item.leaf").alias("leaf"), "subroot", "root",
        F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256).alias("proof_sha256"),
        fold(F.col("item._tampered")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, grouped by language."""
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
#: The same in DuckDB SQL: crc32 by its table, levels by recursion, proofs from siblings, the fold by recursion.
ORACLES = {"op13_merkle_manifest": r"""
with recursive
t as (select list_transform(range(256), lambda b: list_reduce(range(8),
  lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, b::ubigint)) as tbl),
src as (
  select d.*, row_number() over () as rid,
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::ubigint),
      lambda acc, ch: xor(tbl[((xor(acc, ch) & 255) + 1)::bigint], acc >> 8), 4294967295::ubigint), 4294967295::ubigint) as crc
  from documents d, t),
rows as (
  select rid, doc_id, lang,
    sha256(case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id::varchar end
      || case when source is null then '-' else strlen(source) || ':' || source end
      || case when lang is null then '-' else strlen(lang) || ':' || lang end
      || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars::varchar end
      || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
    case when doc_id is not null and text is not null and crc % 3 = 0
      then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as ttext,
    source, n_chars
  from src),
leaves as (
  select rid, doc_id, lang, leaf,
    sha256(case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id::varchar end
      || case when source is null then '-' else strlen(source) || ':' || source end
      || case when lang is null then '-' else strlen(lang) || ':' || lang end
      || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars::varchar end
      || case when ttext is null then '-' else strlen(ttext) || ':' || ttext end) as tleaf,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i,
    count(*) over (partition by lang) as n
  from rows),
tree(lang, lvl, i, d, n) as (
  select lang, 0, i, leaf, n from leaves
  union all
  select lang, lvl + 1, i // 8, sha256(string_agg(d, '' order by i)), (n + 7) // 8
  from tree where n > 1 group by lang, lvl, i // 8, n),
subroots as (select lang, d as subroot from tree where n = 1),
tops as (select lang, subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from subroots),
top(lvl, i, d, n) as (
  select 0, i, subroot, n from tops
  union all
  select lvl + 1, i // 8, sha256(string_agg(d, '' order by i)), (n + 7) // 8 from top where n > 1 group by lvl, i // 8, n),
root as (select d as root from top where n = 1),
lpath as (
  select l.rid, 0 as phase, k.lvl as step,
    coalesce(string_agg(s.d, '' order by s.i) filter (where s.i < l.i >> (3 * k.lvl)), '') as lft,
    coalesce(string_agg(s.d, '' order by s.i) filter (where s.i > l.i >> (3 * k.lvl)), '') as rgt
  from leaves l join (select distinct lang, lvl from tree where n > 1) k on k.lang is not distinct from l.lang
  join tree s on s.lang is not distinct from l.lang and s.lvl = k.lvl and s.i // 8 = (l.i >> (3 * k.lvl)) // 8
  group by l.rid, k.lvl),
tpath as (
  select g.lang, 1 as phase, k.lvl as step,
    coalesce(string_agg(s.d, '' order by s.i) filter (where s.i < g.i >> (3 * k.lvl)), '') as lft,
    coalesce(string_agg(s.d, '' order by s.i) filter (where s.i > g.i >> (3 * k.lvl)), '') as rgt
  from tops g join (select distinct lvl from top where n > 1) k on true
  join top s on s.lvl = k.lvl and s.i // 8 = (g.i >> (3 * k.lvl)) // 8
  group by g.lang, g.i, k.lvl),
steps as (
  select rid, phase, step, lft, rgt from lpath
  union all
  select l.rid, p.phase, p.step, p.lft, p.rgt from leaves l join tpath p on p.lang is not distinct from l.lang),
path as (select rid, row_number() over (partition by rid order by phase, step) as pos, lft, rgt from steps),
fold(rid, pos, h) as (
  select rid, 0, tleaf from leaves
  union all
  select f.rid, f.pos + 1, sha256(p.lft || f.h || p.rgt) from fold f join path p on p.rid = f.rid and p.pos = f.pos + 1),
folded as (select rid, arg_max(h, pos) as folded_root from fold group by rid),
proofs as (select rid, string_agg(lft || rgt, '' order by pos) as sibs from path group by rid)
select l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.sibs, '')) as proof_sha256, f.folded_root,
  f.folded_root = r.root as verified
from leaves l join subroots s on s.lang is not distinct from l.lang cross join root r
join folded f on f.rid = l.rid left join proofs p on p.rid = l.rid
"""}
