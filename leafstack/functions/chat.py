"""Expressions over the message array of a chat request."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..defaults import HISTORY_TURNS, PARTS_FOLLOW_UP, TOOLS_FOLLOW_UP


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def last_question(messages: Column) -> Column:
    """Content of the last message, whatever its role."""
    return F.try_element_at(messages, F.lit(-1))["content"]


def history(messages: Column, turns: int = HISTORY_TURNS) -> Column:
    """The tail of ``turns`` messages, without the last one if it is the user's."""
    size = F.size(messages)
    first = F.greatest(size - turns, F.lit(0))
    own = F.when(F.try_element_at(messages, F.lit(-1))["role"] == "user", 1).otherwise(0)
    return F.slice(messages, first + 1, size - first - own)


def prompt_history(hist: Column) -> Column:
    """Only the turns of the two speakers, in order."""
    return F.filter(hist, lambda m: m["role"].isin("user", "assistant"))


def append_turn(hist: Column, question: Column, answer: Column) -> Column:
    return F.concat(hist, F.array(message("user", question), message("assistant", answer)))


def questions(question: Column) -> Column:
    """The main question and its two follow-ups."""
    return F.array(
        F.struct(F.lit("main").alias("kind"), question.alias("question")),
        F.struct(
            F.lit("parts").alias("kind"),
            F.concat(question, F.lit("\n" + PARTS_FOLLOW_UP)).alias("question"),
        ),
        F.struct(
            F.lit("tools").alias("kind"),
            F.concat(question, F.lit("\n" + TOOLS_FOLLOW_UP)).alias("question"),
        ),
    )


def joined_rewrite(hist: Column, question: Column) -> Column:
    """Stand-in for a rewriting model: the history and the question as one text."""
    return F.concat_ws("\n", F.transform(hist, lambda m: m["content"]), question)
