"""Tables derived from the test data, as frames and as SQL for the oracles.

Every group formed here is bounded: a manual is one source's documents within
a span of 200 ids, so a source that holds a third of all documents still gives
many manuals of at most 200 pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.feedback import dedupe_assessments
from ..operators.windows import latest_per_key
from ..sources import load, spread

SPAN = 200


def with_ctes(select: str, *ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


# Manuals

def _in_manuals(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    title = F.concat_ws("-", "source", F.expr(f"doc_id div {SPAN}").cast("string"))
    return spread(docs.withColumn("title", title), "title")


def manual_pages(spark: SparkSession, sf: str) -> DataFrame:
    place = Window.partitionBy("title").orderBy("doc_id")
    return _in_manuals(spark, sf).select(
        F.concat(F.lit("dbfs:/manuals/"), "title", F.lit(".pdf")).alias("path"), "title",
        (F.row_number().over(place) - 1).alias("page_number"), "doc_id", "text",
    )


def manual_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    return _in_manuals(spark, sf).groupBy("title").agg(
        F.array_join(F.transform(pages, lambda p: p["text"]), "\f").alias("text")
    )


def manual_files(spark: SparkSession, sf: str) -> DataFrame:
    return manual_text(spark, sf).withColumn(
        "path", F.concat(F.lit("dbfs:/manuals/"), "title", F.lit(".pdf"))
    )


MANUALS = f"""manuals as (
  select concat('dbfs:/manuals/', title, '.pdf') as url, concat('/manuals/', title, '.pdf') as path, title,
    row_number() over (partition by title order by doc_id) - 1 as page_number, doc_id, text
  from (select *, concat(source, '-', doc_id // {SPAN}) as title from documents))"""


def manual_md(spark: SparkSession, sf: str) -> DataFrame:
    ticks = "```"
    lines = [
        F.concat(F.lit("# Manual "), "source"), F.lit("intro"), F.lit("-----"),
        F.concat(F.lit("## Doc "), F.col("doc_id").cast("string")), F.col("text"),
        F.lit("| Item | Name |"), F.lit("|---|---|"), F.concat(F.lit("| 1 | "), "lang", F.lit(" |")),
        F.lit(ticks), F.lit("# not a heading"), F.lit(ticks), F.lit("### End"), F.col("lang"),
    ]
    docs = spread(load(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    return docs.select("doc_id", F.concat_ws("\n", *lines).alias("text"))


MANUAL_MD = """manual_md as (
  select doc_id, concat('# Manual ', source, chr(10), 'intro', chr(10), '-----', chr(10), '## Doc ', doc_id,
    chr(10), text, chr(10), '| Item | Name |', chr(10), '|---|---|', chr(10), '| 1 | ', lang, ' |', chr(10),
    repeat('`', 3), chr(10), '# not a heading', chr(10), repeat('`', 3), chr(10), '### End', chr(10), lang) as md
  from documents)"""

MD_LINES = """md_lines as (
  select doc_id, i as pos, lines[i + 1] as line
  from (select doc_id, string_split(md, chr(10)) as lines from manual_md), unnest(range(0, len(lines))) t(i))"""


# Vectors of texts

def embedded_sql(source: str, key: str = "id", text: str = "t", name: str = "vec") -> str:
    """CTEs that give ``name(key, v)`` from the texts of ``source``."""
    return f"""{name}_tok as (
  select {key}, unnest([x for x in regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+') if x <> '']) as tok
  from {source}),
{name}_cnt as (
  select {key}, ('0x' || substr(md5(tok), 1, 8))::bigint % 64 as b, count(*) as c from {name}_tok group by all),
{name}_nrm as (select {key}, sqrt(sum(c * c)) as n from {name}_cnt group by all),
{name} as (
  select s.{key}, list(coalesce(c.c / n.n, 0)::float order by g.b) as v
  from {source} s cross join range(64) g(b)
  left join {name}_cnt c on c.{key} = s.{key} and c.b = g.b left join {name}_nrm n on n.{key} = s.{key}
  group by s.{key})"""


DIGEST_SQL = "list_aggregate([cast(round(x::double * 1e6) as bigint) for x in {v}], 'string_agg', ',')"


def digest(vector) -> "F.Column":
    """A vector as text, for comparison."""
    scaled = F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string"))
    return F.array_join(scaled, ",")


# Part lists

def part_lists(spark: SparkSession, sf: str) -> DataFrame:
    lines = latest_per_key(
        load(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
        ),
        ["l_orderkey", "l_linenumber"],
        [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")],
    )
    part = load(spark, sf, "part").select("p_partkey", "p_name")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_linenumber").cast("bigint").alias("item_number"),
            F.col("l_partkey").cast("string").alias("part_number"),
            F.col("p_name").alias("designation"),
            F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("part_code"),
            F.col("o_orderpriority").alias("part_name"),
            F.concat(F.lit("http://parts.example/"), F.col("l_orderkey").cast("string"))
            .alias("qr_code_url"),
        )
    )


PART_LISTS = """part_lists as (
  select cast(l.l_linenumber as bigint) as item_number, cast(l.l_partkey as varchar) as part_number,
    p.p_name as designation, concat('A', o.o_custkey) as part_code, o.o_orderpriority as part_name,
    concat('http://parts.example/', l.l_orderkey) as qr_code_url, l.l_orderkey as assembly_id
  from (select *, row_number() over (partition by l_orderkey, l_linenumber
          order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) as rn from lineitem) l
  join part p on l.l_partkey = p.p_partkey join orders o on l.l_orderkey = o.o_orderkey
  where l.rn = 1)"""


# Logs

def request_logs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    turns = load(spark, sf, "conversations")
    user = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("request")
    )
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("logged_request_id"),
        "request", "response",
    )


REQUEST_LOGS = """request_logs as (
  select u.conv_id * 1000 + u.turn as logged_request_id, u.text as request, a.text as response
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  where u.role = 'user')"""


def assessment_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as reviews: the user picks the conversation, the event the turn."""
    e = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kind = F.col("event_type")
    rating = (
        F.when(kind == "click", "positive").when(kind == "error", "negative")
        .when(kind == "view", "neutral")
    )
    suggested = F.when(
        kind.isin("error", "click") & (F.col("event_id") % 2 == 0),
        F.concat(F.lit("edit "), F.col("event_id").cast("string")),
    ).otherwise("")
    answer = F.struct(F.col("rating").alias("value"))
    return e.withColumn("rating", rating).select(
        (F.col("user_id") * 1000 + F.col("event_id") % 5).alias("request_id"),
        F.col("ts").alias("timestamp"),
        (F.col("event_id") % 4).alias("step_id"),
        F.struct((F.col("event_id") % 3).alias("id")).alias("source"),
        F.when(
            F.col("rating").isNotNull(),
            F.struct(
                F.create_map(F.lit("answer_correct"), answer).alias("ratings"),
                suggested.alias("suggested_output"),
            ),
        ).alias("text_assessment"),
        F.when(
            kind.isin("purchase", "signup"),
            F.struct(
                F.concat(F.lit("doc"), (F.col("event_id") % 9).cast("string")).alias("doc_uri"),
                F.when(F.col("value") >= 50, "positive").otherwise("negative").alias("rating"),
                F.col("event_id"),
            ),
        ).alias("retrieval_assessment"),
        F.lit("1").alias("schema_version"),
    )


ASSESSMENTS = """assessments as (
  select user_id * 1000 + event_id % 5 as request_id, ts, event_id % 4 as step_id, event_id % 3 as source_id, event_id,
    case event_type when 'click' then 'positive' when 'error' then 'negative' when 'view' then 'neutral' end as rating,
    case when event_type in ('error', 'click') and event_id % 2 = 0 then concat('edit ', event_id) else '' end as suggested,
    event_type in ('purchase', 'signup') as is_retrieval, concat('doc', event_id % 9) as doc_uri,
    case when value >= 50 then 'positive' else 'negative' end as doc_rating
  from events)"""

LATEST_TEXT = """latest_text as (
  select * from (select *, row_number() over (partition by request_id
      order by ts desc, source_id desc, step_id desc, rating desc, suggested desc) as rn from assessments where rating is not null)
  where rn = 1)"""

RETRIEVAL = """retrieval as (
  select request_id, source_id, step_id, max(ts) as ts,
    string_agg(event_id::varchar, ',' order by doc_uri, doc_rating, event_id) as events
  from assessments where is_retrieval group by all)"""


def deduped(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    return dedupe_assessments(assessment_logs(spark, sf), strict)


def dedupe_sql(strict: bool) -> str:
    keys = (
        "t.request_id, t.source_id" if strict
        else "coalesce(t.request_id, r.request_id) as request_id, coalesce(t.source_id, r.source_id) as source_id"
    )
    return f"""deduped as (
  select {keys}, t.ts, t.rating, t.suggested, r.events
  from latest_text t full join retrieval r on t.request_id = r.request_id and t.source_id = r.source_id)"""
