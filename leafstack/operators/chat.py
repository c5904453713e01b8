"""Chat requests as a batch: one row per conversation, all answered by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..defaults import (
    CHUNK_FORMAT, EMBED_BATCH, HISTORY_TURNS, REWRITE_INSTRUCTIONS, SYSTEM_TEMPLATE, TOP_K,
)
from ..functions import chat as ch
from ..functions.text import file_name
from ..functions.udfs import hash_embed
from . import vector_index
from .documents import embed
from .similarity import RECALL, ann_topk, topk


def recent_requests(turns: DataFrame, keep: int = HISTORY_TURNS) -> DataFrame:
    """Long-form turns as requests ``conv_id, messages`` with the last ``keep`` turns.

    ``keep`` is the number of turns given to ``parse_requests``, and the limit per conversation also
    runs before the shuffle: a conversation of any length sends ``keep`` rows
    per task and ends as a short array.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), "role", "text")
    tail = turns.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= keep)
    return tail.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(-F.col("n"), "role", "text"))),
            lambda m: ch.message(m["role"], m["text"]),
        ).alias("messages")
    )


def parse_requests(requests: DataFrame, turns: int = HISTORY_TURNS) -> DataFrame:
    """Add question, history and the history a prompt shows.

    ``recent_requests`` must keep at least as many turns.
    """
    return (
        requests.withColumn("question", ch.last_question(F.col("messages")))
        .withColumn("history", ch.history(F.col("messages"), turns))
        .withColumn("prompt_history", ch.prompt_history(F.col("history")))
    )


def fan_out(parsed: DataFrame) -> DataFrame:
    """Three rows per request: main, parts and tools question."""
    keep = [c for c in parsed.columns if c not in ("question", "kind")]
    return parsed.select(*keep, F.inline(ch.questions(F.col("question"))))


def query_text(
    df: DataFrame, rewrite: Callable[[Column, Column], Column] = ch.joined_rewrite
) -> DataFrame:
    """Add the text to search with: rewritten if there is a history."""
    question, hist = F.col("question"), F.col("history")
    return df.withColumn(
        "query", F.when(F.size(hist) > 0, rewrite(hist, question)).otherwise(question)
    )


def retrieve(
    parsed: DataFrame, chunks: DataFrame, k: int = TOP_K, fn: Callable = hash_embed,
    rewrite: Callable = ch.joined_rewrite, approximate: bool = False, batch_size: int = EMBED_BATCH,
    index: str | None = None,
) -> DataFrame:
    """The k chunks for each of the three questions of every request.

    With ``index``, the folder of a stored index of the chunks' vectors, that
    is searched, and of ``chunks`` only the payload is read.

    Equal query texts are embedded and searched once: a text that many
    conversations share costs one search. Results come back by the digest of
    the text.
    """
    asked = query_text(fan_out(parsed), rewrite).select(
        "conv_id", "kind", F.sha2("query", 256).alias("query_id"), "query"
    )
    distinct = asked.dropDuplicates(["query_id"]).select("query_id", "query")
    vectors = embed(distinct, "query", fn, batch_size).select("query_id", "embedding")
    payload = ["content", "url", "path", "page_number"]
    if index is not None:
        found = vector_index.search(vectors, index, k, recall=RECALL if approximate else None)
        found = found.join(chunks.select("id", *payload), "id")
    else:
        found = (ann_topk if approximate else topk)(vectors, chunks, k, payload=payload)
    return asked.drop("query").join(found, "query_id").drop("query_id")


def context(found: DataFrame) -> DataFrame:
    """Context text per conversation: passages of a kind in order, kinds line by line."""
    passage = F.format_string(CHUNK_FORMAT, "content", "page_number", "url")
    ranked = F.array_sort(F.collect_list(F.struct("rank", passage.alias("passage"))))
    per_kind = found.groupBy("conv_id", "kind").agg(
        F.array_join(F.transform(ranked, lambda p: p["passage"]), "").alias("text")
    )
    kind = lambda name: F.coalesce(F.max(F.when(F.col("kind") == name, F.col("text"))), F.lit(""))
    return per_kind.groupBy("conv_id").agg(
        F.concat_ws("\n", kind("main"), kind("parts"), kind("tools")).alias("context")
    )


def prompt(
    parsed: DataFrame, contexts: DataFrame, system: str = SYSTEM_TEMPLATE,
    instructions: str = REWRITE_INSTRUCTIONS,
) -> DataFrame:
    """Messages for the model: system text, history, and the tools question at the end."""
    rows = parsed.join(contexts, "conv_id", "left")
    head = F.replace(
        F.lit(system + instructions), F.lit("{context}"), F.coalesce("context", F.lit(""))
    )
    final = F.element_at(ch.questions(F.col("question")), -1)["question"]
    return rows.select(
        "conv_id",
        F.concat(
            F.array(ch.message("system", head)), F.col("prompt_history"),
            F.array(ch.message("user", final)),
        ).alias("messages"),
    )


def combine_references(found: DataFrame, uri_prefix: str) -> DataFrame:
    """Distinct chunks of a conversation over all three questions, pages from 1."""
    distinct = found.select(
        "conv_id", "id", "content", "url", "path", F.col("page_number")
    ).distinct()
    return distinct.select(
        "conv_id", "id", "content",
        F.concat(F.lit(uri_prefix), file_name(F.col("url"))).alias("doc_uri"),
        (F.col("page_number") + 1).cast("int").alias("page_number"),
    )


def reference_lists(references: DataFrame) -> DataFrame:
    """References of a conversation as a list, ordered by page and id."""
    entry = F.struct("page_number", "id", "content", "doc_uri")
    return references.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda r: F.struct(r["content"], r["doc_uri"], r["page_number"]),
        ).alias("references")
    )


def response_json(answers: DataFrame, references: DataFrame) -> DataFrame:
    """``{answer, references}`` as JSON; ``answers`` has ``conv_id, answer``."""
    rows = answers.join(reference_lists(references), "conv_id", "left")
    empty = F.from_json(F.lit("[]"), "array<struct<content:string,doc_uri:string,page_number:int>>")
    return rows.select(
        "conv_id",
        F.to_json(
            F.struct("answer", F.coalesce("references", empty).alias("references")), {"ignoreNullFields": "false"}
        )
        .alias("response"),
    )


def reference_lines(references: DataFrame) -> DataFrame:
    return references.select(
        "conv_id", "id",
        F.format_string(
            "page %d from %s", F.col("page_number"), file_name(F.col("doc_uri"))
        ).alias("line"),
    )
