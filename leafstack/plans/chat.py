"""Chat requests in bulk over the conversations and the manuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..defaults import PARTS_FOLLOW_UP, REWRITE_INSTRUCTIONS, SYSTEM_TEMPLATE, TOOLS_FOLLOW_UP
from ..functions import chat as ch
from ..operators import chat as ops, feedback, vector_index
from ..operators.documents import chunk_windows, embed, normalise_path
from ..session import scratch_path
from ..sources import load
from . import fixtures as fx

URI_PREFIX = "http://manuals.example/"


def parsed(spark, sf):
    return ops.parse_requests(ops.recent_requests(load(spark, sf, "conversations")))


def chunk_table(spark, sf):
    """Window chunks of the manuals; the id is unique by document and position."""
    pages = normalise_path(fx.manual_pages(spark, sf))
    chunks = chunk_windows(pages).withColumn("id", F.col("doc_id") * 1_000_000 + F.col("chunk_no"))
    return embed(chunks).select("id", "path", "title", "url", "page_number", "content", "embedding")


def _found(spark, sf):
    return ops.retrieve(parsed(spark, sf), chunk_table(spark, sf))


def _text(messages):
    """A message list as text, for comparison."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def g1_last_question(spark, sf):
    return parsed(spark, sf).select("conv_id", "question")


def g2_history(spark, sf):
    return parsed(spark, sf).select("conv_id", _text(F.col("history")).alias("history"))


def g3_prompt_history(spark, sf):
    return parsed(spark, sf).select("conv_id", _text(F.col("prompt_history")).alias("history"))


def g4_append_turn(spark, sf):
    rows = parsed(spark, sf).withColumn("answer", F.concat(F.lit("re: "), "question"))
    longer = ch.append_turn(F.col("history"), F.col("question"), F.col("answer"))
    return rows.select("conv_id", _text(longer).alias("history"))


def g5_fan_out(spark, sf):
    return ops.fan_out(parsed(spark, sf)).select("conv_id", "kind", "question")


def g6_query_text(spark, sf):
    return ops.query_text(ops.fan_out(parsed(spark, sf))).select("conv_id", "kind", "query")


def _ranks(found):
    return found.select(
        "conv_id", "kind", "id", F.col("rank").cast("bigint").alias("rank"), "score", "url"
    )


def g7_retrieve(spark, sf):
    return _ranks(_found(spark, sf))


def g7_retrieve_indexed(spark, sf):
    """The same from a stored index of the chunks."""
    chunks, root = chunk_table(spark, sf), scratch_path(spark, "index")
    vector_index.create_index(chunks.select("id", "embedding"), root)
    return _ranks(ops.retrieve(parsed(spark, sf), chunks, index=root))


def g8_context(spark, sf):
    return ops.context(_found(spark, sf))


def g9_prompt(spark, sf):
    rows = ops.prompt(parsed(spark, sf), ops.context(_found(spark, sf)))
    return rows.select("conv_id", _text(F.col("messages")).alias("messages"))


def _references(spark, sf):
    return ops.combine_references(_found(spark, sf), URI_PREFIX)


def g10_references(spark, sf):
    return _references(spark, sf)


def _answers(spark, sf):
    return parsed(spark, sf).select("conv_id", F.concat(F.lit("re: "), "question").alias("answer"))


def g11_response_json(spark, sf):
    return ops.response_json(_answers(spark, sf), _references(spark, sf))


def g12_reference_lines(spark, sf):
    return ops.reference_lines(_references(spark, sf))


def f6_eval_rows(spark, sf):
    """Answers with references, reshaped for an evaluation."""
    answers = (
        parsed(spark, sf).select("conv_id", F.col("question").alias("request"))
        .join(_answers(spark, sf), "conv_id")
        .join(ops.reference_lists(_references(spark, sf)), "conv_id")
    )
    rows = feedback.to_eval_rows(answers)
    shown = F.transform("retrieved_context", lambda c: F.concat(c["doc_uri"], F.lit(" "), F.md5(c["content"])))
    return rows.withColumn("retrieved_context", F.array_join(shown, "\n"))


QUERIES = {f.__name__: f for f in (
    g1_last_question, g2_history, g3_prompt_history, g4_append_turn, g5_fan_out, g6_query_text,
    g7_retrieve, g7_retrieve_indexed, g8_context, g9_prompt, g10_references, g11_response_json, g12_reference_lines,
    f6_eval_rows,
)}

_PARSED = """sized as (select conv_id, turn, role, text, max(turn) over (partition by conv_id) as last,
    row_number() over (partition by conv_id order by turn desc) as back from conversations),
ending as (select conv_id, role as last_role, text as question from sized where back = 1),
hist as (
  select conv_id, turn, role, text from sized join ending using (conv_id)
  where back <= 5 and not (back = 1 and last_role = 'user')),
histories as (
  select e.conv_id, e.question,
    string_agg(h.role || ': ' || h.text, chr(10) order by h.turn) filter (h.role is not null) as full_text,
    string_agg(h.role || ': ' || h.text, chr(10) order by h.turn) filter (h.role in ('user', 'assistant')) as spoken,
    string_agg(h.text, chr(10) order by h.turn) filter (h.role is not null) as said
  from ending e left join hist h using (conv_id) group by e.conv_id, e.question)"""

_FAN = f"""fan as (
  select conv_id, said, 'main' as kind, question from histories
  union all select conv_id, said, 'parts', question || chr(10) || '{PARTS_FOLLOW_UP}' from histories
  union all select conv_id, said, 'tools', question || chr(10) || '{TOOLS_FOLLOW_UP}' from histories),
asked as (
  select conv_id, kind, question, case when said is null then question else said || chr(10) || question end as query
  from fan)"""

_CHUNKS = """words as (select *, [x for x in regexp_split_to_array(text, '\\s+') if x <> ''] as w from manuals),
chunks as (
  select doc_id * 1000000 + st // 490 as id, path, title, url, page_number,
    array_to_string(w[st + 1:st + 500], ' ') as content
  from (select *, unnest(range(0, greatest(len(w) - 11, 0) + 1, 490)) as st from words) where len(w) > 0)"""

_FOUND = (
    _PARSED, _FAN, fx.MANUALS, _CHUNKS, fx.embedded_sql("chunks", "id", "content", "cvec"),
    "texts as (select distinct query from asked)",
    fx.embedded_sql("texts", "query", "query", "qvec"),
    """pairs as (
  select q.query, c.id, round(pow(list_distance(q.v::double[], c.v::double[]), 2), 9) as key from qvec q, cvec c),
best as (
  select * from (select *, row_number() over (partition by query order by key, id) as rank from pairs)
  where rank <= 3),
found as (
  select conv_id, kind, id, rank, round(1 / (1 + key), 6) as score, path, url, page_number, content
  from asked join best using (query) join chunks using (id))""",
)

_CONTEXT = """passages as (
  select conv_id, kind, string_agg(concat('Passage: ', content, chr(10), 'Source: Page ', page_number, ' from ', url,
    chr(10)), '' order by rank) as text from found group by all),
contexts as (
  select conv_id, concat_ws(chr(10), coalesce(max(text) filter (kind = 'main'), ''),
    coalesce(max(text) filter (kind = 'parts'), ''), coalesce(max(text) filter (kind = 'tools'), '')) as context
  from passages group by conv_id)"""

_REFS = f"""refs as (
  select distinct conv_id, id, content, concat('{URI_PREFIX}', split_part(url, '/', -1)) as doc_uri,
    (page_number + 1)::int as page_number from found)"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ORACLES = {
    "g1_last_question": fx.with_ctes("select conv_id, question from histories", _PARSED),
    "g2_history": fx.with_ctes("select conv_id, coalesce(full_text, '') as history from histories", _PARSED),
    "g3_prompt_history": fx.with_ctes("select conv_id, coalesce(spoken, '') as history from histories", _PARSED),
    "g4_append_turn": fx.with_ctes(
        """select conv_id, concat_ws(chr(10), full_text, 'user: ' || question, 'assistant: re: ' || question) as history
from histories""",
        _PARSED,
    ),
    "g5_fan_out": fx.with_ctes("select conv_id, kind, question from fan", _PARSED, _FAN),
    "g6_query_text": fx.with_ctes("select conv_id, kind, query from asked", _PARSED, _FAN),
    "g7_retrieve": fx.with_ctes("select conv_id, kind, id, rank, score, url from found", *_FOUND),
    "g7_retrieve_indexed": fx.with_ctes("select conv_id, kind, id, rank, score, url from found", *_FOUND),
    "g8_context": fx.with_ctes("select conv_id, context from contexts", *_FOUND, _CONTEXT),
    "g9_prompt": fx.with_ctes(
        f"""select conv_id, concat_ws(chr(10), 'system: ' || replace({_sql_text(SYSTEM_TEMPLATE + REWRITE_INSTRUCTIONS)},
  '{{context}}', coalesce(context, '')), spoken, 'user: ' || question || chr(10) || '{TOOLS_FOLLOW_UP}') as messages
from histories left join contexts using (conv_id)""",
        *_FOUND, _CONTEXT,
    ),
    "g10_references": fx.with_ctes("select conv_id, id, content, doc_uri, page_number from refs", *_FOUND, _REFS),
    "g11_response_json": fx.with_ctes(
        """select conv_id, to_json({'answer': 're: ' || question, 'references': coalesce(list({'content': content,
  'doc_uri': doc_uri, 'page_number': page_number} order by page_number, id) filter (id is not null), [])})::varchar as response
from histories left join refs using (conv_id) group by conv_id, question""",
        *_FOUND, _REFS,
    ),
    "g12_reference_lines": fx.with_ctes(
        "select conv_id, id, concat('page ', page_number, ' from ', split_part(doc_uri, '/', -1)) as line from refs",
        *_FOUND, _REFS,
    ),
    "f6_eval_rows": fx.with_ctes(
        """select question as request, 're: ' || question as response,
  string_agg(doc_uri || ' ' || md5(content), chr(10) order by page_number, id) as retrieved_context
from histories join refs using (conv_id) group by conv_id, question""",
        *_FOUND, _REFS,
    ),
}
