"""Python functions take an Arrow batch in pieces and keep its rows in order."""

import pyarrow as pa

from leafstack.functions import udfs


def test_long_texts_become_objects_a_few_at_a_time(spark):
    texts = pa.array(["x" * 300_000] * 40 + [None])
    sizes = [sum(len(t or "") for t in piece) for piece in udfs._pieces(iter([texts, texts[:0]]))]
    assert sum(sizes) == 12_000_000 and max(sizes) <= udfs.PIECE_BYTES + 300_000


def test_rows_stay_in_order(spark):
    rows = [(i, f"{i}" * 50_000 if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    out = df.select("i", "t", udfs.parser_udf(lambda t: [(t[:3], 1, t), (None, "2", "")])("t").alias("p"),
                    udfs.parser_error_udf(lambda t: [(t[:3], 1, t)])("t").alias("e"),
                    udfs.embedding_udf(lambda ts: [[float(len(t or ""))] for t in ts], 3)("t").alias("v")).collect()
    for r in out:
        if r["t"] is None:
            assert r["p"] is None and r["e"].startswith("TypeError") and r["v"] == [0.0]
        else:
            assert [tuple(p) for p in r["p"]] == [(r["t"][:3], 1, r["t"]), (None, 2, "")]
            assert r["e"] is None and r["v"] == [float(len(r["t"]))]
    assert [r["i"] for r in out] == list(range(200))
