"""Part lists and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parts as ops
from ..operators.joins import upsert
from ..sources import load
from . import fixtures as fx


def _assemblies(spark, sf):
    return ops.with_assembly(fx.part_lists(spark, sf))


def c1_links(spark, sf):
    return ops.extract_links(load(spark, sf, "pages").select("url", "html"))


def c2_listing(spark, sf):
    return ops.extract_listing(load(spark, sf, "pages"))


def c3_scrape(spark, sf):
    """All pages merged into a list that was made from the English pages before, and is outdated."""
    pages = load(spark, sf, "pages").select("url", "html")
    before = ops.scrape(pages.filter(F.col("html").contains('<html lang="en">')))
    before = before.withColumn("designation", F.lit("outdated"))
    return ops.scrape(pages, before)


def c4_assembly_options(spark, sf):
    return ops.assembly_options(_assemblies(spark, sf))


def c5_parts_of(spark, sf):
    """The parts of one assembly."""
    return ops.parts_of(_assemblies(spark, sf), 7)


def c5_parts_by_assembly(spark, sf):
    return ops.parts_by_assembly(_assemblies(spark, sf))


def c7_guided_questions(spark, sf):
    return ops.guided_questions(_assemblies(spark, sf))


def d5_upsert(spark, sf):
    rows = fx.part_lists(spark, sf)
    target = rows.filter(F.col("part_name") != "1-URGENT")
    source = rows.filter(F.col("part_name") != "5-LOW").withColumn(
        "designation", F.concat("designation", F.lit("*"))
    )
    return upsert(target, source, ops.PART_KEYS)


QUERIES = {f.__name__: f for f in (
    c1_links, c2_listing, c3_scrape, c4_assembly_options, c5_parts_of, c5_parts_by_assembly, c7_guided_questions, d5_upsert,
)}

LISTING = """items as (
  select page_id, url, html, unnest(range(1, len(items) + 1)) as n, unnest(items) as item from (
    select *, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 0) as items from pages)),
listing as (
  select n as item_number, regexp_extract(item, 'href="([^"]*)"', 1) as part_number,
    regexp_extract(item, '>([^<]*)</a>', 1) as designation,
    regexp_extract(html, '<h1>([^<]*)</h1>', 1) as part_code,
    regexp_extract(html, '<title>([^<]*)</title>', 1) as part_name, url as qr_code_url,
    regexp_extract(html, '<html lang="([^"]*)"', 1) as lang
  from items)"""

_COLUMNS = "item_number, part_number, designation, part_code, part_name, qr_code_url"

ORACLES = {
    "c1_links": """with l as (
  select url, unnest(range(0, len(links))) as n, unnest(links) as link from (
    select url, regexp_extract_all(html, 'href="([^"]*)"', 1) as links from pages))
select concat(replace(split_part(url, '/', -1), '.pdf', ''), '_', n) as key, trim(link) as link from l""",
    "c2_listing": fx.with_ctes(f"select {_COLUMNS} from listing", LISTING),
    "c3_scrape": fx.with_ctes(f"select {_COLUMNS} from listing", LISTING),
    "c4_assembly_options": fx.with_ctes(
        "select distinct part_name as label, assembly_id as value, part_code from part_lists", fx.PART_LISTS
    ),
    "c5_parts_of": fx.with_ctes(
        "select distinct item_number, designation from part_lists where assembly_id = 7", fx.PART_LISTS
    ),
    "c5_parts_by_assembly": fx.with_ctes(
        "select distinct assembly_id, item_number, designation from part_lists", fx.PART_LISTS
    ),
    "c7_guided_questions": fx.with_ctes(
        """select assembly_id, concat('Help me to replace the part ', part_name, '.', chr(10),
  'Take into account what is known about these items:', chr(10),
  string_agg('- ' || designation, chr(10) order by item_number, designation)) as question
from (select distinct assembly_id, part_name, item_number, designation from part_lists)
group by assembly_id, part_name""",
        fx.PART_LISTS,
    ),
    "d5_upsert": fx.with_ctes(
        """select item_number, part_number,
  case when part_name = '5-LOW' then designation else designation || '*' end as designation,
  part_code, part_name, qr_code_url from part_lists""",
        fx.PART_LISTS,
    ),
}
