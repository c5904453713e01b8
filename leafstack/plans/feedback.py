"""Assessment logs and evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as ops
from ..operators.windows import collect_retrieval
from . import fixtures as fx


def _events(column):
    """The list of retrieval assessments as text, for comparison."""
    return F.array_join(F.transform(column, lambda r: r["event_id"].cast("string")), ",")


def _flat(df):
    return df.select(
        "request_id", F.col("source.id").alias("source_id"), F.col("timestamp").alias("ts"),
        ops.rating().alias("rating"), F.col("text_assessment.suggested_output").alias("suggested"),
        _events(F.col("retrieval_assessments")).alias("events"),
    )


def d1_requests_with_feedback(spark, sf):
    joined = ops.requests_with_feedback(fx.request_logs(spark, sf), fx.deduped(spark, sf))
    return joined.select(
        "logged_request_id", F.md5("response").alias("response"),
        F.col("source.id").alias("source_id"), ops.rating().alias("rating"),
        _events(F.col("retrieval_assessments")).alias("events"),
    )


def d2_rated_requests(spark, sf):
    latest = ops.latest_text(fx.assessment_logs(spark, sf))
    requests = fx.request_logs(spark, sf)
    return latest.join(requests, latest["request_id"] == requests["logged_request_id"]).select(
        "request_id", ops.rating().alias("rating"), F.md5("request").alias("request")
    )


def d3_full_join_strict(spark, sf):
    return _flat(fx.deduped(spark, sf, strict=True))


def e2_collect_retrieval(spark, sf):
    return collect_retrieval(fx.assessment_logs(spark, sf)).select(
        "request_id", F.col("source.id").alias("source_id"), "step_id", F.col("timestamp").alias("ts"),
        _events(F.col("retrieval_assessments")).alias("events"),
    )


def e3_drop_columns(spark, sf):
    """All but the nested columns, as a log view would show."""
    logs = fx.assessment_logs(spark, sf).withColumn("source_id", F.col("source.id"))
    return logs.drop("text_assessment", "retrieval_assessment", "source", "schema_version")


def f1_rating_predicate(spark, sf):
    """Neither equal nor unequal: rows without a rating fail both tests."""
    value = ops.rating()
    return fx.assessment_logs(spark, sf).agg(
        F.count(F.when(value == "positive", 1)).alias("equal"),
        F.count(F.when(value != "positive", 1)).alias("unequal"),
        F.count(F.lit(1)).alias("all_rows"),
    )


def f2_expected(spark, sf):
    return fx.assessment_logs(spark, sf).filter(F.col("text_assessment").isNotNull()).select(
        "request_id", "timestamp", ops.expected().alias("expected_response")
    )


def f3_dedupe(spark, sf):
    return _flat(fx.deduped(spark, sf))


def f4_eval_set(spark, sf):
    return ops.eval_set(fx.request_logs(spark, sf), ops.rated_assessments(fx.assessment_logs(spark, sf)))


def f5_eval_set_documented(spark, sf):
    rows = ops.eval_set_documented(fx.request_logs(spark, sf), fx.assessment_logs(spark, sf))
    return rows.withColumn("expected_retrieved_context", F.array_join("expected_retrieved_context", ","))


QUERIES = {f.__name__: f for f in (
    d1_requests_with_feedback, d2_rated_requests, d3_full_join_strict, e2_collect_retrieval,
    e3_drop_columns, f1_rating_predicate, f2_expected, f3_dedupe, f4_eval_set, f5_eval_set_documented,
)}

_DEDUPE = (fx.ASSESSMENTS, fx.LATEST_TEXT, fx.RETRIEVAL)
_FLAT = "select request_id, source_id, ts, rating, suggested, events from deduped"

ORACLES = {
    "d1_requests_with_feedback": fx.with_ctes(
        """select logged_request_id, md5(response) as response, source_id, rating, events
from request_logs left join deduped on logged_request_id = request_id""",
        fx.REQUEST_LOGS, *_DEDUPE, fx.dedupe_sql(False),
    ),
    "d2_rated_requests": fx.with_ctes(
        """select request_id, rating, md5(request) as request
from latest_text join request_logs on logged_request_id = request_id""",
        fx.REQUEST_LOGS, fx.ASSESSMENTS, fx.LATEST_TEXT,
    ),
    "d3_full_join_strict": fx.with_ctes(_FLAT, *_DEDUPE, fx.dedupe_sql(True)),
    "e2_collect_retrieval": fx.with_ctes(
        "select request_id, source_id, step_id, ts, events from retrieval", fx.ASSESSMENTS, fx.RETRIEVAL
    ),
    "e3_drop_columns": fx.with_ctes(
        "select request_id, ts as timestamp, step_id, source_id from assessments", fx.ASSESSMENTS
    ),
    "f1_rating_predicate": fx.with_ctes(
        """select count(*) filter (rating = 'positive') as equal, count(*) filter (rating <> 'positive') as unequal,
  count(*) as all_rows from assessments""",
        fx.ASSESSMENTS,
    ),
    "f2_expected": fx.with_ctes(
        """select request_id, ts as timestamp, nullif(suggested, '') as expected_response
from assessments where rating is not null""",
        fx.ASSESSMENTS,
    ),
    "f3_dedupe": fx.with_ctes(_FLAT, *_DEDUPE, fx.dedupe_sql(False)),
    "f4_eval_set": fx.with_ctes(
        """select request_id, request, response as expected_response, 'thumbs_up' as type, source_id as user_id
from deduped join request_logs on logged_request_id = request_id where rating = 'positive'
union all select request_id, request, nullif(suggested, ''), 'thumbs_down', source_id
from deduped join request_logs on logged_request_id = request_id where rating = 'negative'
union all select request_id, request, nullif(suggested, ''), 'no_feedback_provided', source_id
from deduped join request_logs on logged_request_id = request_id
where rating <> 'negative' and rating <> 'positive'""",
        fx.REQUEST_LOGS, *_DEDUPE, fx.dedupe_sql(True),
    ),
    "f5_eval_set_documented": fx.with_ctes(
        """select r.logged_request_id as request_id, request,
  case rating when 'positive' then coalesce(nullif(suggested, ''), response)
    when 'negative' then nullif(suggested, '') end as expected_response,
  case rating when 'positive' then 'thumbs_up' when 'negative' then 'thumbs_down'
    else 'no_feedback_provided' end as type,
  source_id as user_id, uris as expected_retrieved_context
from request_logs r left join latest_text t on r.logged_request_id = t.request_id
left join (select request_id, string_agg(distinct doc_uri, ',' order by doc_uri) as uris from assessments
  where is_retrieval and doc_rating = 'positive' group by request_id) g on g.request_id = r.logged_request_id""",
        fx.REQUEST_LOGS, fx.ASSESSMENTS, fx.LATEST_TEXT,
    ),
}
