from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leafstack.functions import text as tx
from leafstack.functions.udfs import hash_embed, sentence_chunks
from leafstack.operators import documents as ops


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("c")).head()["c"]


def section_lines(text):
    """Sections by a scan over the lines."""
    out, fenced = [[]], False
    for n, line in enumerate(text.split("\n")):
        if line.lstrip(" \t").startswith("```"):
            fenced = not fenced
        elif not fenced and n and line.startswith("#") and line.lstrip("#")[:1] in (" ", "\t"):
            out.append([])
        out[-1].append(line)
    joined = ["\n".join(s) for s in out]
    return [s for s in joined if s.strip(" \t\n")]


MARKDOWN = [
    "", "plain", "# a", "# a\nb\n## c\nd", "intro\n# a\n\n# b", "#no\n# yes", "a\n#\tb\n\n\n",
    "```\n# in\n```\n# out", "x\n```py\n# in\n# in\n", "```\n# in\n``` \n# b\n```\n# in2\n```\n# c\nend",
    "  ```\n# in\n  ```\n# b", "# a\n```\n\n```\n```\n# q\n```\n# z", "a\x01b\n# c\x02\n# d\x02e\x01m",
    "| a |\n# t\n| b |", "a\r\n# b\r\n", "\n\n# a\n\n", "# a\n# b\n# c\n",
]


def test_sections_follow_the_lines(spark):
    rows = [(i, t) for i, t in enumerate(MARKDOWN)]
    got = ops.chunk_sections(spark.createDataFrame(rows, "i int, text string")).collect()
    for i, text in rows:
        mine = [r["content"] for r in sorted(got, key=lambda r: r["chunk_no"]) if r["i"] == i]
        assert mine == section_lines(text), text


def test_sections_random(spark):
    rng = np.random.default_rng(5)
    bits = ["# h", "## x y", "text", "```", "", "   ", "| a |", "#x", "  ```py", "a # b"]
    texts = ["\n".join(rng.choice(bits, size=n)) for n in rng.integers(1, 14, 300)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", tx.sections(F.col("text")).alias("s")
    ).collect()
    for r in got:
        assert r["s"] == section_lines(r["text"])


def test_strip_marks(spark):
    assert one(spark, "## a b\ntext\n\n# c", tx.sections(F.col("text"), True)) == ["a b\ntext", "c"]


def test_null_text_gives_no_chunk(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "i int, text string")
    assert ops.chunk_sections(df).count() == 0
    assert ops.chunk_windows(df).count() == 0
    assert ops.chunk_sentences(df).count() == 0


def test_tables(spark):
    text = "| a |\n| b |\ntext\n  | c |\n\n| d |"
    assert one(spark, text, tx.tables(F.col("text"))) == ["| a |\n| b |", "  | c |", "| d |"]
    assert one(spark, text, tx.prose(F.col("text"))) == "text\n"
    assert one(spark, "none", tx.tables(F.col("text"))) == []
    assert one(spark, "| only |", tx.prose(F.col("text"))) == ""


def test_long_page_of_table_lines(spark):
    text = "\n".join(["| x |"] * 20000 + ["end"] + ["| y |"] * 20000)
    got = one(spark, text, tx.tables(F.col("text")))
    assert [len(t.split("\n")) for t in got] == [20000, 20000]


def test_windows(spark):
    for n in (1, 9, 10, 11, 490, 500, 501, 511, 990, 991, 1001):
        words = [str(i) for i in range(n)]
        got = one(spark, " ".join(words), tx.windows(F.col("text"), 500, 10))
        expect, start = [], 0
        while start == 0 or start + 10 < n:
            expect.append(" ".join(words[start:start + 500]))
            start += 490
        assert got == expect, n


def test_pages_and_rejects(spark):
    def parser(content):
        if content == b"bad":
            raise ValueError("no pages")
        return [(None, i, t) for i, t in enumerate(content.decode().split("|"))]

    rows = [("dbfs:/m/a.pdf", b"x|y"), ("dbfs:/m/b.pdf", b"bad"), ("dbfs:/m/c.pdf", b"z")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    parsed = ops.parse_pages(ops.normalise_path(df), parser)
    pages = ops.explode_pages(parsed, parser)
    got = {(r["path"], r["title"], r["page_number"], r["text"]) for r in pages.collect()}
    assert got == {("/m/a.pdf", None, 0, "x"), ("/m/a.pdf", None, 1, "y"), ("/m/c.pdf", None, 0, "z")}
    assert [r["path"] for r in ops.rejected(parsed).collect()] == ["/m/b.pdf"]


def test_text_pages(spark):
    df = spark.createDataFrame([("a", "p0\fp1\f"), ("b", ""), ("c", None)], "title string, text string")
    got = sorted((r["title"], r["page_number"], r["text"]) for r in ops.explode_pages(df).collect())
    assert got == [("a", 0, "p0"), ("a", 1, "p1"), ("b", 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=0, max_size=12), st.integers(4, 9), st.integers(0, 3))
def test_sentence_packing(lengths, size, overlap):
    text = " ".join(" ".join(f"w{i}x{j}" for j in range(n)) + "." for i, n in enumerate(lengths))
    chunks = [c.split() for c in sentence_chunks(text, size, overlap)]
    assert all(0 < len(c) <= size for c in chunks)
    assert set(w for c in chunks for w in c) == set(text.split())
    # Without the words that repeat from the chunk before, the text is whole and in order.
    seen, order = set(), []
    for chunk in chunks:
        fresh = [w for w in chunk if w not in seen]
        assert fresh and len(chunk) - len(fresh) <= overlap
        seen.update(fresh)
        order.extend(fresh)
    assert order == text.split()


def test_embedding_batches_and_errors(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "i int, text string").coalesce(1)

    def count(texts):
        assert len(texts) <= 150
        return [[float(len(texts)), float(t[1:])] for t in texts]

    rows = ops.embed(df, "text", count).collect()
    assert all(r["embedding"][1] == r["i"] for r in rows)
    assert Counter(r["embedding"][0] for r in rows) == {150.0: 300, 100.0: 100}

    def fail(texts):
        raise RuntimeError("service down")

    try:
        ops.embed(df, "text", fail).collect()
        raise AssertionError("should fail")
    except Exception as e:
        assert "service down" in str(e)


def test_hash_embed():
    a, b, c, d = hash_embed(["Ein Wort, ein Wort", "", "WORT ein", None])
    assert abs(float((a * a).sum()) - 1) < 1e-6 and not b.any() and not d.any()
    assert np.allclose(a, c)


def test_ids_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    rows = ops.assign_ids(df, ["k"], start=5).collect()
    assert sorted((r["k"], r["id"]) for r in rows) == [(i, i + 5) for i in range(1000)]


def test_headings(spark):
    df = spark.createDataFrame([("# a",), ("x\n## b",), ("#c",), ("d",)], "text string")
    assert sorted(r["text"] for r in ops.with_headings(df).collect()) == ["# a", "x\n## b"]


def test_sentence_packing_is_a_fold_equal_to_the_python_one(spark):
    import random

    from leafstack.functions import text as tx

    rng = random.Random(3)
    words = ["alpha", "be", "c.", "d!", "eee?", "f", "g.\n", "h", " i."]
    texts = [None, "", "   ", "One. Two three! Four?"] + [
        " ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size, overlap in ((20, 5), (7, 3), (3, 0)):
        got = df.select("i", tx.sentence_chunks(F.col("text"), size, overlap).alias("c"))
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        rows = {r.i: r.c for r in got.collect()}
        assert all(rows[i] == ([] if t is None else sentence_chunks(t, size, overlap)) for i, t in enumerate(texts))
