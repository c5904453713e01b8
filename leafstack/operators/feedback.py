"""From request and feedback logs to evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .windows import collect_retrieval, latest_per_key, retrieval_keys

# The id column of the request log; every function that reads it takes another name.
REQUEST_KEY = "logged_request_id"


def rating(assessment: str | Column = "text_assessment", name: str = "answer_correct") -> Column:
    """The rating; NULL, hence neither equal nor unequal to anything, if there is none."""
    column = F.col(assessment) if isinstance(assessment, str) else assessment
    return column["ratings"][name]["value"]


def expected(assessment: str | Column = "text_assessment") -> Column:
    """The edited answer, NULL if it is empty."""
    column = F.col(assessment) if isinstance(assessment, str) else assessment
    return F.when(column["suggested_output"] != "", column["suggested_output"])


def latest_text(assessments: DataFrame) -> DataFrame:
    """Newest text assessment of each request."""
    return latest_per_key(
        assessments.filter(F.col("text_assessment").isNotNull()),
        ["request_id"],
        [F.col("timestamp").desc(), F.col("source.id").desc(), F.col("step_id").desc(),
         rating().desc(), F.col("text_assessment.suggested_output").desc()],
    )


def _reviewed(retrieval: DataFrame) -> DataFrame:
    return retrieval.select(
        F.col("request_id").alias("request_id2"), F.col("source").alias("source2"),
        *[c for c in retrieval.columns if c == "retrieval_assessments"],
    )


_SAME_REVIEW = "request_id = request_id2 and source.id = source2.id"


def dedupe_assessments(assessments: DataFrame, strict: bool = False) -> DataFrame:
    """Latest text assessment beside the retrieval lists of the same reviewer.

    ``strict`` keeps the key columns of the text side only, so that rows with
    retrieval assessments alone have NULL keys; otherwise both sides fill them.
    Both sides are aggregated by their keys before they meet: a key has one
    text row and a row per step.
    """
    text = latest_text(assessments).drop("retrieval_assessment", "step_id")
    merged = text.join(_reviewed(collect_retrieval(assessments)), F.expr(_SAME_REVIEW), "full_outer")
    if not strict:
        merged = merged.withColumn("request_id", F.coalesce("request_id", "request_id2"))
        merged = merged.withColumn("source", F.coalesce("source", "source2"))
    return merged.select(*text.columns, "retrieval_assessments")


def rated_assessments(assessments: DataFrame) -> DataFrame:
    """The text rows of ``dedupe_assessments``, as often as there, without the lists."""
    text = latest_text(assessments).drop("retrieval_assessment", "step_id")
    return text.join(_reviewed(retrieval_keys(assessments)), F.expr(_SAME_REVIEW), "left").select(*text.columns)


def requests_with_feedback(
    requests: DataFrame, latest: DataFrame, key: str = REQUEST_KEY
) -> DataFrame:
    """Every request with its rows of ``latest``, if any."""
    return requests.join(latest, requests[key] == latest["request_id"], "left")


def eval_set(requests: DataFrame, latest: DataFrame, key: str = REQUEST_KEY) -> DataFrame:
    """Evaluation rows of the rated requests: one join and one pass for all ratings."""
    value = rating()
    kind = (
        F.when(value == "positive", "thumbs_up")
        .when(value == "negative", "thumbs_down")
        .when((value != "positive") & (value != "negative"), "no_feedback_provided")
    )
    joined = latest.join(
        requests, latest["request_id"] == requests[key], "inner"
    )
    return joined.withColumn("type", kind).filter(F.col("type").isNotNull()).select(
        "request_id", "request",
        F.when(F.col("type") == "thumbs_up", F.col("response")).otherwise(expected())
        .alias("expected_response"),
        "type", F.col("source.id").alias("user_id"),
    )


def approved_context(assessments: DataFrame) -> DataFrame:
    """Sources of the chunks that reviewers approved, per request.

    Distinct pairs are formed before the list: its length is the number of
    different sources approved for the request, not the number of reviews.
    """
    good = assessments.filter(F.col("retrieval_assessment.rating") == "positive")
    pairs = good.select("request_id", F.col("retrieval_assessment.doc_uri").alias("uri")).distinct()
    return pairs.groupBy("request_id").agg(
        F.sort_array(F.collect_list("uri")).alias("expected_retrieved_context")
    )


def eval_set_documented(
    requests: DataFrame, assessments: DataFrame, key: str = REQUEST_KEY
) -> DataFrame:
    """Evaluation rows of all requests: edits win over responses, unrated requests stay."""
    value = rating()
    text = latest_text(assessments).select(
        "request_id", value.alias("rating"), expected().alias("edit"),
        F.col("source.id").alias("user_id"),
    )
    context = approved_context(assessments)
    rows = requests.join(
        text, requests[key] == text["request_id"], "left"
    ).drop("request_id").join(
        context, requests[key] == context["request_id"], "left"
    )
    return rows.select(
        F.col(key).alias("request_id"),
        "request",
        F.when(F.col("rating") == "positive", F.coalesce("edit", "response"))
        .when(F.col("rating") == "negative", F.col("edit")).alias("expected_response"),
        F.when(F.col("rating") == "positive", "thumbs_up")
        .when(F.col("rating") == "negative", "thumbs_down")
        .otherwise("no_feedback_provided").alias("type"),
        "user_id",
        "expected_retrieved_context",
    )


def to_eval_rows(answers: DataFrame) -> DataFrame:
    """Answers with references to the columns an evaluation reads."""
    return answers.select(
        "request",
        F.col("answer").alias("response"),
        F.transform("references", lambda r: F.struct(r["doc_uri"], r["content"]))
        .alias("retrieved_context"),
    )


def retriever_metrics(ranked: DataFrame, truth: DataFrame, k: int = 3, digits: int | None = 6) -> DataFrame:
    """Precision, recall and ndcg at k per question, rounded to ``digits`` (None: not at all).

    ``ranked`` has ``question, rank, source``; ``truth`` has ``question,
    source``. Only the k ranked rows of a question meet its truth, by an equal
    join, and the size of the truth is counted apart: no pairs are formed.
    """
    truth = truth.select("question", "source").distinct()
    wanted = truth.groupBy("question").agg(F.count(F.lit(1)).alias("wanted"))
    rows = ranked.filter(F.col("rank") <= k).join(
        truth.withColumn("rel", F.lit(1.0)), ["question", "source"], "left"
    )
    gain = F.coalesce("rel", F.lit(0.0))
    per = rows.groupBy("question").agg(
        F.count(F.lit(1)).alias("shown"),
        F.sum(gain).alias("hits"),
        F.count_distinct(F.when(F.col("rel") == 1, F.col("source"))).alias("found"),
        F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    ones = F.least(F.lit(k), F.greatest(F.col("wanted"), F.col("hits").cast("int")))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(ones, F.lit(1)).cast("int")), F.lit(0.0),
        lambda total, i: total + F.lit(1.0) / F.log2(i + 1),
    )
    shown = F.coalesce("shown", F.lit(0))
    share = lambda top, base: F.when(base > 0, top / base).otherwise(0.0)
    shown_as = lambda c: F.coalesce(c if digits is None else F.round(c, digits), F.lit(0.0))
    return wanted.join(per, "question", "left").select(
        "question",
        shown_as(share(F.col("hits"), shown)).alias("precision"),
        shown_as(share(F.col("found"), F.col("wanted"))).alias("recall"),
        shown_as(F.col("dcg") / ideal).alias("ndcg"),
    )


def mean_metrics(per_question: DataFrame) -> DataFrame:
    """Means over all questions; ``per_question`` should not be rounded, the means are."""
    return per_question.agg(*[
        F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "ndcg")
    ])
