"""Part lists: extraction from pages, look-ups and guided questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..defaults import GUIDED_TEMPLATE
from ..functions.text import file_name, file_stem
from .joins import replace_by_key

_LINK = 'href="([^"]*)"'
_ITEM = r'<li><a href="([^"]*)">([^<]*)</a></li>'



def extract_links(pages: DataFrame, name: str = "url", html: str = "html") -> DataFrame:
    """One row per link of a page, with a key made of page and position."""
    links = pages.select(
        F.col(name), F.posexplode(F.regexp_extract_all(html, F.lit(_LINK), 1)).alias("n", "link")
    )
    return links.select(
        F.concat_ws("_", file_stem(F.col(name)), F.col("n").cast("string")).alias("key"),
        F.trim("link").alias("link"),
    )


def extract_listing(pages: DataFrame) -> DataFrame:
    """List items of a page as part rows; the page's headings repeat on each row."""
    first = lambda pattern: F.regexp_extract("html", pattern, 1)
    rows = pages.select(
        "url",
        first("<h1>([^<]*)</h1>").alias("part_code"),
        first("<title>([^<]*)</title>").alias("part_name"),
        F.posexplode(F.regexp_extract_all("html", F.lit(_ITEM), 0)).alias("n", "item"),
    )
    return rows.select(
        (F.col("n") + 1).cast("bigint").alias("item_number"),
        F.regexp_extract("item", _ITEM, 1).alias("part_number"),
        F.regexp_extract("item", _ITEM, 2).alias("designation"),
        "part_code", "part_name", F.col("url").alias("qr_code_url"),
    )


PART_KEYS = ["qr_code_url", "part_code", "item_number"]


def scrape(pages: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Part rows of all pages in one plan, merged into ``target`` if there is one.

    Pages that share an address and a heading all keep their rows.
    """
    found = extract_listing(pages)
    return found if target is None else replace_by_key(target, found, PART_KEYS)


def with_assembly(parts: DataFrame) -> DataFrame:
    """Add ``assembly_id``, the number at the end of the assembly's address, if it is one."""
    return parts.withColumn(
        "assembly_id", file_name(F.col("qr_code_url")).try_cast("bigint")
    )


def assembly_options(parts: DataFrame) -> DataFrame:
    """Distinct assemblies with the label and the value a picker shows."""
    return parts.select("assembly_id", "part_code", "part_name").distinct().select(
        F.col("part_name").alias("label"), F.col("assembly_id").alias("value"), "part_code"
    )


def parts_of(parts: DataFrame, assembly_id: int) -> DataFrame:
    """Distinct parts of one assembly. The id is a parameter, never part of the text."""
    return parts.sparkSession.sql(
        "SELECT DISTINCT item_number, designation FROM {parts} WHERE assembly_id = :id",
        args={"id": assembly_id}, parts=parts,
    )


def parts_by_assembly(parts: DataFrame) -> DataFrame:
    """Distinct parts of every assembly at once."""
    return parts.select("assembly_id", "item_number", "designation").distinct()


def guided_questions(
    parts: DataFrame, action: str | Column = "replace", template: str = GUIDED_TEMPLATE,
) -> DataFrame:
    """A question per assembly that lists its parts as bullets.

    ``template`` takes the action, the part name and the bullets. There is one
    question per assembly and part name at any size; duplicates are removed in
    each task first. Assemblies without a name or without parts get none.
    """
    action = F.lit(action) if isinstance(action, str) else action
    chosen = parts.filter(
        F.col("part_name").isNotNull() & (F.col("part_name") != "") & F.col("designation").isNotNull()
    ).select("assembly_id", "part_name", "item_number", "designation")
    bullets = F.transform(
        F.array_sort(F.collect_set(F.struct("item_number", "designation"))),
        lambda p: F.concat(F.lit("- "), p["designation"]),
    )
    return chosen.groupBy("assembly_id", "part_name").agg(bullets.alias("bullets")).select(
        "assembly_id",
        F.format_string(
            template, action, F.col("part_name"), F.array_join("bullets", "\n")
        ).alias("question"),
    )
