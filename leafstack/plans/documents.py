"""Documents, pages, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as ops
from ..sources import load, spread
from . import fixtures as fx


def _texts(spark, sf):
    return spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def b1_normalise_path(spark, sf):
    return ops.normalise_path(fx.manual_pages(spark, sf)).select("doc_id", "url", "path")


def b2_explode_pages(spark, sf):
    pages = ops.explode_pages(fx.manual_text(spark, sf))
    return pages.select("title", "page_number", "text")


def _numbered(df):
    return df.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "content")


def b3_sections(spark, sf):
    return _numbered(ops.chunk_sections(fx.manual_md(spark, sf)))


def b4_sentences(spark, sf):
    return _numbered(ops.chunk_sentences(_texts(spark, sf)))


def b5_windows(spark, sf):
    return _numbered(ops.chunk_windows(_texts(spark, sf)))


def b6_clean(spark, sf):
    return fx.manual_md(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


def b7_prose(spark, sf):
    return ops.isolate_tables(fx.manual_md(spark, sf))[0]


def b7_tables(spark, sf):
    tables = ops.isolate_tables(fx.manual_md(spark, sf))[1]
    return tables.select("doc_id", F.col("table_no").cast("bigint").alias("table_no"), "content")


def b8_with_headings(spark, sf):
    """Sections of the manuals that have a heading of their own."""
    sections = ops.chunk_sections(fx.manual_md(spark, sf))
    return _numbered(ops.with_headings(sections, "content"))


def b10_embed(spark, sf):
    vectors = ops.embed(_texts(spark, sf), "text")
    return vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter(
        "w > 0"
    ).select(
        "doc_id", F.col("bucket").cast("bigint").alias("bucket"),
        F.round(F.col("w").cast("double"), 6).alias("weight"),
    )


def b11_final_chunks(spark, sf):
    chunks = ops.preprocess(fx.manual_files(spark, sf))
    return chunks.withColumn("embedding", fx.digest(F.col("embedding")))


def b12_page_counts(spark, sf):
    return ops.page_counts(ops.normalise_path(fx.manual_pages(spark, sf)).select("path"))


def c6_known_paths(spark, sf):
    return ops.known_paths(ops.normalise_path(fx.manual_pages(spark, sf)).select("path"))


def k2_chunker_udf(spark, sf):
    """A user's chunker: the lines of a document."""
    return _numbered(ops.chunk_with(_texts(spark, sf), lambda t: t.split("\n")))


def k3_parser_udf(spark, sf):
    """A user's parser that reads pages from text."""
    def parser(content):
        return [("parsed", i, page) for i, page in enumerate(content.split("\f"))]

    pages = ops.explode_pages(fx.manual_files(spark, sf), parser, "text")
    return pages.select("path", "title", F.col("page_number").cast("int").alias("page_number"), "text")


def h2_file_names(spark, sf):
    return fx.manual_pages(spark, sf).select(
        "doc_id", tx.file_name(F.col("path")).alias("file"), tx.file_stem(F.col("path")).alias("stem")
    )


QUERIES = {f.__name__: f for f in (
    b1_normalise_path, b2_explode_pages, b3_sections, b4_sentences, b5_windows, b6_clean, b7_prose,
    b7_tables, b8_with_headings, b10_embed, b11_final_chunks, b12_page_counts, c6_known_paths,
    h2_file_names, k2_chunker_udf, k3_parser_udf,
)}

_SECTIONS = """fenced as (select *, regexp_matches(line, '^\\s*```') as fence from md_lines),
open as (select *, sum(fence::int) over (partition by doc_id order by pos) as n from fenced),
heads as (
  select *, (not fence and n % 2 = 0 and regexp_matches(line, '^#+\\s'))::int as head from open),
numbered as (select *, sum(head) over (partition by doc_id order by pos) as sec from heads),
sections as (
  select doc_id, row_number() over (partition by doc_id order by sec) - 1 as chunk_no, content from (
    select doc_id, sec, string_agg(line, chr(10) order by pos) as content from numbered group by all)
  where trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> '')"""

_RUNS = """flagged as (select *, regexp_matches(line, '^\\s*\\|') as tab from md_lines),
starts as (
  select *, (tab and not coalesce(lag(tab) over (partition by doc_id order by pos), false))::int as first from flagged),
runs as (select *, sum(first) over (partition by doc_id order by pos) as run from starts)"""

_PACK = """units as (
  select doc_id, s, p, w[p * 500 + 1:p * 500 + 500] as w from (
    select doc_id, s, w, unnest(range(0, (len(w) + 499) // 500)) as p from (
      select doc_id, s, [x for x in regexp_split_to_array(part, '\\s+') if x <> ''] as w from (
        select doc_id, unnest(range(1, len(parts) + 1)) as s, unnest(parts) as part from (
          select doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as parts
          from documents))))),
sized as (
  select doc_id, list(array_to_string(w, ' ') order by s, p) as u, list(len(w) order by s, p) as n
  from units group by doc_id),
totals as (
  select doc_id, u, list_concat([0], [list_sum(n[1:i]) for i in range(1, len(n) + 1)]) as t from sized)"""

ORACLES = {
    "b1_normalise_path": fx.with_ctes("select doc_id, url, path from manuals", fx.MANUALS),
    "b2_explode_pages": fx.with_ctes(
        "select title, page_number::int as page_number, text from manuals", fx.MANUALS
    ),
    "b3_sections": fx.with_ctes(
        "select doc_id, chunk_no, content from sections", fx.MANUAL_MD, fx.MD_LINES, _SECTIONS
    ),
    "b4_sentences": "with recursive " + _PACK + """,
pack(doc_id, no, first, fresh, stop) as (
  select doc_id, -1::bigint, 0::bigint, 0::bigint, 0::bigint from totals
  union all
  select doc_id, no + 1, start, fin, fin from (
    select doc_id, no, start, len([x for x in t if x <= t[start + 1] + 500]) - 1 as fin from (
      select p.doc_id, p.no, t.t, t.u,
        case when t.t[p.fresh + 2] - t.t[carry + 1] > 500 then p.fresh else carry end as start
      from (select p.*, len([x for x in t.t if x < t.t[p.stop + 1] - 10]) as carry
            from pack p join totals t using (doc_id)) p
      join totals t using (doc_id) where p.fresh < len(t.u))))
select doc_id, no as chunk_no, array_to_string(u[first + 1:stop], ' ') as content
from pack join totals using (doc_id) where no >= 0""",
    "b5_windows": """with w as (select doc_id, [x for x in regexp_split_to_array(text, '\\s+') if x <> ''] as w from documents),
s as (select doc_id, w, unnest(range(0, greatest(len(w) - 11, 0) + 1, 490)) as st from w)
select doc_id, st // 490 as chunk_no, array_to_string(w[st + 1:st + 500], ' ') as content from s where len(w) > 0""",
    "b6_clean": fx.with_ctes(
        "select doc_id, trim(replace(md, '-----', ''), ' ' || chr(9) || chr(10) || chr(13)) as text from manual_md",
        fx.MANUAL_MD,
    ),
    "b7_prose": fx.with_ctes(
        "select doc_id, string_agg(line, chr(10) order by pos) as text from runs where not tab group by doc_id",
        fx.MANUAL_MD, fx.MD_LINES, _RUNS,
    ),
    "b7_tables": fx.with_ctes(
        """select doc_id, run::bigint - 1 as table_no, string_agg(line, chr(10) order by pos) as content
from runs where tab group by doc_id, run""",
        fx.MANUAL_MD, fx.MD_LINES, _RUNS,
    ),
    "b8_with_headings": fx.with_ctes(
        "select doc_id, chunk_no, content from sections where regexp_matches(content, '(?m)^#+\\s')",
        fx.MANUAL_MD, fx.MD_LINES, _SECTIONS,
    ),
    "b10_embed": fx.with_ctes(
        """select vec.doc_id, b as bucket, round((c / n)::float::double, 6) as weight
from vec_cnt vec join vec_nrm using (doc_id)""",
        fx.embedded_sql("documents", "doc_id", "text"),
    ),
    "b11_final_chunks": fx.with_ctes(
        f"""select path, title, url, page_number::int as page_number, text as content,
  {fx.DIGEST_SQL.format(v='v')} as embedding from manuals join vec using (doc_id)""",
        fx.MANUALS, fx.embedded_sql("documents", "doc_id", "text"),
    ),
    "b12_page_counts": fx.with_ctes("select path, count(*) as pages from manuals group by path", fx.MANUALS),
    "c6_known_paths": fx.with_ctes("select distinct path from manuals", fx.MANUALS),
    "k2_chunker_udf": """select doc_id, unnest(range(0, len(l))) as chunk_no, unnest(l) as content
from (select doc_id, string_split(text, chr(10)) as l from documents)""",
    "k3_parser_udf": fx.with_ctes(
        "select url as path, 'parsed' as title, page_number::int as page_number, text from manuals", fx.MANUALS
    ),
    "h2_file_names": fx.with_ctes(
        "select doc_id, split_part(path, '/', -1) as file, replace(split_part(path, '/', -1), '.pdf', '') as stem from manuals",
        fx.MANUALS,
    ),
}
