import json

import pytest
from pyspark.sql import functions as F

from leafstack.functions import chat as ch
from leafstack.operators import chat as ops, feedback, parts
from leafstack.schemas import REQUESTS
from leafstack.sources import from_rows


def requests(spark, *conversations):
    rows = [(i, [(r, f"m{n}") for n, r in enumerate(c)]) for i, c in enumerate(conversations)]
    return from_rows(spark, rows, REQUESTS).withColumnRenamed("request_id", "conv_id")


@pytest.mark.parametrize("last", ["user", "assistant", "system"])
def test_history_lengths(spark, last):
    roles = ["user", "assistant", "system", "user", "assistant", "user", "user"]
    convs = [roles[:n] + [last] for n in range(8)]
    for r in ops.parse_requests(requests(spark, *convs)).collect():
        messages = [(m["role"], m["content"]) for m in r["messages"]]
        expect = messages[-5:-1] if last == "user" else messages[-5:]
        assert [(m["role"], m["content"]) for m in r["history"]] == expect
        assert [(m["role"], m["content"]) for m in r["prompt_history"]] == [m for m in expect if m[0] != "system"]
        assert r["question"] == messages[-1][1]


def test_empty_request(spark):
    row = ops.parse_requests(requests(spark, [])).head()
    assert (row["question"], row["history"], row["prompt_history"]) == (None, [], [])


def test_recent_requests_equal_the_whole(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c}-{t}") for c, n in ((1, 3), (2, 40)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for r in ops.recent_requests(turns).collect():
        whole = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [(m["role"], m["content"]) for m in r["messages"]] == whole[-5:]


def test_rewrite_only_with_history(spark):
    parsed = ops.parse_requests(requests(spark, ["user"], ["user", "assistant", "user"]))
    out = ops.query_text(ops.fan_out(parsed), lambda h, q: F.concat(F.lit("re:"), q)).collect()
    for r in out:
        assert r["query"].startswith("re:") == (r["conv_id"] == 1)
    assert len(out) == 6


def test_append_turn(spark):
    df = requests(spark, ["system"]).select(
        ch.append_turn(F.col("messages"), F.lit("q"), F.lit("a")).alias("m")
    )
    assert [tuple(m) for m in df.head()["m"]] == [("system", "m0"), ("user", "q"), ("assistant", "a")]


def test_response_without_references(spark):
    found = spark.createDataFrame(
        [(1, 5, "c", "u/f.pdf", "p", 0), (1, 5, "c", "u/f.pdf", "p", 0), (1, 4, "b", "u/f.pdf", "p", 3)],
        "conv_id bigint, id bigint, content string, url string, path string, page_number int",
    )
    answers = spark.createDataFrame([(1, "x"), (2, "y")], "conv_id bigint, answer string")
    refs = ops.combine_references(found, "http://h/")
    out = {r["conv_id"]: json.loads(r["response"]) for r in ops.response_json(answers, refs).collect()}
    assert out[2] == {"answer": "y", "references": []}
    assert out[1]["references"] == [
        {"content": "c", "doc_uri": "http://h/f.pdf", "page_number": 1},
        {"content": "b", "doc_uri": "http://h/f.pdf", "page_number": 4},
    ]
    assert {r["line"] for r in ops.reference_lines(refs).collect()} == {"page 1 from f.pdf", "page 4 from f.pdf"}


def test_approximate_retrieval(spark):
    parsed = ops.parse_requests(requests(spark, ["user"], ["user"]))
    chunks = spark.createDataFrame(
        [(i, f"m{i % 2} tools {i}", "u", "p", 0) for i in range(30)],
        "id bigint, content string, url string, path string, page_number int",
    )
    from leafstack.operators.documents import embed
    out = ops.retrieve(parsed, embed(chunks), k=2, approximate=True).collect()
    assert len(out) == 12


def test_metrics(spark):
    ranked = spark.createDataFrame(
        [("q", 1, "a"), ("q", 2, "x"), ("q", 3, "a"), ("r", 1, "x")], "question string, rank int, source string"
    )
    truth = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "z"), ("s", "z")], "question string, source string")
    out = {r["question"]: r for r in feedback.retriever_metrics(ranked, truth).collect()}
    assert (out["q"]["precision"], out["q"]["recall"]) == (0.666667, 0.5)
    assert out["q"]["ndcg"] == round((1 + 0.5) / (1 + 1 / 1.584962500721156), 6)
    for name in ("r", "s"):
        assert (out[name]["precision"], out[name]["recall"], out[name]["ndcg"]) == (0, 0, 0)


def test_parts_of_takes_a_parameter(spark):
    rows = [(1, "bolt", "n", 7), (1, "bolt", "n", 7), (2, "nut", "n", 7), (1, "rod", "n", 8), (1, "cap", "", 9)]
    df = spark.createDataFrame(rows, "item_number bigint, designation string, part_name string, assembly_id bigint")
    assert sorted(tuple(r) for r in parts.parts_of(df, 7).collect()) == [(1, "bolt"), (2, "nut")]
    questions = {r["assembly_id"]: r["question"] for r in parts.guided_questions(df, "fix").collect()}
    assert set(questions) == {7, 8} and questions[7].endswith("- bolt\n- nut") and "fix the part n" in questions[7]


def test_assembly_ids(spark):
    df = spark.createDataFrame([("http://h/12",), ("http://h/x",)], "qr_code_url string")
    assert [r["assembly_id"] for r in parts.with_assembly(df).collect()] == [12, None]
