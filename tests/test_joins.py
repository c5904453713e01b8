import pytest
from pyspark.sql import functions as F

from leafstack.operators import feedback
from leafstack.operators.changes import change_feed, sync_index
from leafstack.operators.joins import lookup, replace_by_key, upsert
from leafstack.operators.parts import guided_questions
from leafstack.operators.windows import collect_retrieval, latest_per_key, latest_version

T = "k int, j string, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "old"), (2, "a", "keep"), (None, "a", "t"), (3, None, "t3")], T)
    source = spark.createDataFrame(
        [(1, "a", None), (4, "a", "new"), (None, "a", "s"), (None, "a", "s"), (3, None, "s3")], T
    )
    assert rows(upsert(target, source, ["k", "j"])) == sorted([
        (1, "a", None), (2, "a", "keep"), (4, "a", "new"), (None, "a", "t"), (None, "a", "s"),
        (None, "a", "s"), (3, None, "t3"), (3, None, "s3"),
    ], key=str)


def test_upsert_rejects_double_keys(spark):
    target = spark.createDataFrame([(1, "a", "old")], T)
    source = spark.createDataFrame([(1, "a", "x"), (1, "a", "y")], T)
    with pytest.raises(Exception, match="more than one source row"):
        upsert(target, source, ["k", "j"]).collect()


def test_upsert_spreads_null_keys(spark):
    source = spark.createDataFrame([(None, "a", str(i)) for i in range(5000)], T)
    target = spark.createDataFrame([(1, "a", "old")], T)
    out = upsert(target, source, ["k", "j"])
    assert out.count() == 5001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__salt" in plan.split("hashpartitioning(k")[1].split(")")[0]


def test_change_feed_and_sync(spark):
    schema = "k int, v string"
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (5, None)], schema)
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (5, None), (6, "f")], schema)
    feed = change_feed(old, new, ["k"])
    assert rows(feed) == sorted([
        ("update_pre", 2, "b"), ("update_post", 2, "B"), ("update_pre", 3, None),
        ("update_post", 3, "c"), ("delete", 4, "d"), ("insert", 6, "f"),
    ], key=str)
    created = sync_index(None, change_feed(old.limit(0), old, ["k"]), ["k"])
    assert rows(created) == rows(old)
    assert rows(sync_index(created, feed, ["k"])) == rows(new)


def test_lookup_keeps_all_rows(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y"), (9, "z")], "key int, a string")
    features = spark.createDataFrame([(1, "f")], "key int, f string")
    assert rows(lookup(left, features, "key")) == sorted([(1, "x", "f"), (None, "y", None), (9, "z", None)], key=str)
    renamed = features.withColumnRenamed("key", "fk")
    assert rows(lookup(left, renamed, "key", "fk")) == rows(lookup(left, features, "key"))


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 2, 2), ("b", 0, 0)], "k string, t int, i int")
    out = latest_per_key(df, ["k"], [F.col("t").desc(), F.col("i").desc()])
    assert rows(out) == [("a", 2, 2), ("b", 0, 0)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_latest_version_is_numeric(spark):
    df = spark.createDataFrame([("m", "9"), ("m", "10"), ("m", "beta"), ("n", "2")], "name string, version string")
    assert rows(latest_version(df)) == [("m", "10"), ("n", "2")]


@pytest.mark.parametrize("n", [9_999, 10_001, 60_000])
def test_one_row_per_key_at_any_size(spark, n):
    """One hot request: lists, de-duplicated rows, evaluation rows and joins keep their number of rows."""
    kinds = "struct<doc_uri:string,rating:string,event_id:bigint>"
    text = spark.sql("""select 7L request_id, named_struct('id', 1L) source, 0L step_id, timestamp_seconds(5) timestamp,
        named_struct('ratings', map('answer_correct', named_struct('value', 'positive')), 'suggested_output', '') text_assessment""")
    hot = spark.range(n).selectExpr(
        "7L request_id", "named_struct('id', 1L) source", "0L step_id", "timestamp_seconds(id) timestamp",
        "named_struct('doc_uri', 'd', 'rating', 'positive', 'event_id', id) retrieval_assessment",
    )
    logs = text.withColumn("retrieval_assessment", F.lit(None).cast(kinds)).unionByName(hot, allowMissingColumns=True)
    listed = collect_retrieval(logs).collect()
    assert len(listed) == 1 and [x["event_id"] for x in listed[0]["retrieval_assessments"]] == list(range(n))
    requests = spark.createDataFrame([(7, "q", "a"), (8, "q", "a")], "logged_request_id bigint, request string, response string")
    merged = feedback.dedupe_assessments(logs)
    assert [len(r["retrieval_assessments"]) for r in merged.collect()] == [n]
    assert feedback.requests_with_feedback(requests, merged).count() == 2
    assert feedback.dedupe_assessments(logs, strict=True).count() == 1
    assert rows(feedback.eval_set(requests, feedback.rated_assessments(logs))) == [(7, "q", "a", "thumbs_up", 1)]
    parts = spark.range(n).selectExpr("1L assembly_id", "'p' part_name", "id item_number", "concat('d', id) designation")
    asked = guided_questions(parts.union(parts)).collect()
    assert len(asked) == 1 and asked[0]["question"].count("- d") == n


def test_sync_with_null_key(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "A"), (1, "b")], "k int, v string")
    created = sync_index(None, change_feed(old.limit(0), old, ["k"]), ["k"])
    assert rows(sync_index(created, change_feed(old, new, ["k"]), ["k"])) == sorted([(None, "A"), (1, "b")], key=str)


def test_double_source_rows_fail_whatever_is_read(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(Exception, match="more than one source row"):
        upsert(target, source, ["k"]).count()


def test_replace_by_key_keeps_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a", "old"), (1, "a", "older"), (2, "a", "keep"), (2, "a", "keep"), (None, "a", "t")], T)
    source = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (4, "a", "z"), (4, "a", "z"), (None, "a", "s")], T)
    assert rows(replace_by_key(target, source, ["k", "j"])) == sorted([
        (1, "a", "x"), (1, "a", "y"), (2, "a", "keep"), (2, "a", "keep"), (4, "a", "z"), (4, "a", "z"),
        (None, "a", "t"), (None, "a", "s"),
    ], key=str)
    assert rows(replace_by_key(target.limit(0), source, ["k", "j"])) == rows(source)
    assert rows(replace_by_key(target, source.limit(0), ["k", "j"])) == rows(target)
