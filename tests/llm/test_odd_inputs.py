"""Every operator and stage on NULLs, empty and long texts, repeated rows, empty tables and clashing names."""

import public_tokenizers
import pytest

from leafstack.llm import contamination, exact_dedup, language, licenses, mixing, quality, simhash, suffix_dedup, token_files, toxicity
from leafstack.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def tokens(docs):
    path = scratch_path(docs.sparkSession, "odd")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_digests(docs.sparkSession, path)


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, "quick brown fox"), (2, None), (3, ""), (4, "some words of a text and some more words here and there"), (None, "same id")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


OPERATORS = {
    "op1": lambda d, l, b: toxicity.toxicity_scores(d, l),
    "op2": lambda d, l, b: simhash.near_duplicates(d),
    "op3": lambda d, l, b: suffix_dedup.dedup_substrings(d),
    "op4": lambda d, l, b: tokens(d),
    "op5": lambda d, l, b: licenses.license_scan(d),
    "op6": lambda d, l, b: exact_dedup.exact_duplicates(d),
    "op7": lambda d, l, b: contamination.contamination(d, b),
    "op8": lambda d, l, b: mixing.mix(d),
    "op9": lambda d, l, b: language.languages(d, PIECES),
    "op10": lambda d, l, b: quality.quality_scores(d, l),
}


@pytest.fixture(scope="session")
def results(odd, labels, benchmark):
    return {}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(name, odd, labels, benchmark, results):
    rows = OPERATORS[name](odd, labels, benchmark).collect()
    results[name] = rows
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, nothing, labels, benchmark):
    assert OPERATORS[name](nothing, labels, benchmark).collect() == []


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_defined_results(odd, labels, benchmark):
    got = by_id(OPERATORS["op6"](odd, labels, benchmark).collect())
    assert sorted(r["kept"] for r in got[1]) == [False, True, True]  # a repeated row, and another text
    assert (got[2][0]["keep_id"], got[2][0]["group_size"]) == (3, 3) and not got[2][0]["kept"] and got[3][0]["kept"]
    assert got[6][0]["keep_id"] == 7 and not got[6][0]["kept"]
    assert {r["keep_id"] for r in got[None]} == {9, 3}

    got = by_id(OPERATORS["op3"](odd, labels, benchmark).collect())
    assert got[9][0]["n_removed"] == 0 and sorted(r["n_removed"] for r in got[None])[1] == sorted(r["n_bytes"] for r in got[None])[1]
    assert got[7][0]["n_removed"] == got[7][0]["n_bytes"] and got[6][0]["n_removed"] == 0 and got[8][0]["n_removed"] == 0

    got = by_id(OPERATORS["op2"](odd, labels, benchmark).collect())
    assert got[2][0]["fingerprint"] == "0" * 16 and got[2][0]["component_id"] == 2 and got[4][0]["component_id"] == 2
    assert got[7][0]["component_id"] == 6

    got = by_id(OPERATORS["op7"](odd, labels, benchmark).collect())
    assert got[6][0]["contaminated"] and got[6][0]["n_hit"] == 120_000 and not got[2][0]["contaminated"]
    assert sorted((r["n_items"], r["n_hit"]) for r in got[1]) == [(0, 0), (0, 0), (0, 2)]  # by the item without an id

    got = by_id(OPERATORS["op9"](odd, labels, benchmark).collect())
    assert [got[i][0]["lang_pred"] for i in (2, 3, 4, 5)] == ["und"] * 4


def test_stages_on_odd_rows(odd, nothing, benchmark):
    assert set(language.recognised(odd, PIECES).columns) == set(odd.columns)
    kept = simhash.drop_near_duplicates(odd)
    ids = sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    assert kept.columns == odd.columns and ids.count("1") == 2 and "7" not in ids and "6" in ids
    clean = contamination.clean_documents(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    for stage in (lambda d: language.recognised(d, PIECES), simhash.drop_near_duplicates,
                  lambda d: contamination.clean_documents(d, benchmark), mixing.mixed_documents):
        assert stage(nothing).count() == 0


def test_token_stage_on_odd_rows(odd, nothing):
    """The last stage: every row gets its tokens, the end id included, NULL ids first; no rows give no digests."""
    got = tokens(odd).collect()
    assert len(got) == odd.count() and all(r["n_tokens"] >= 1 for r in got)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][:2] == [None, None]
    assert tokens(nothing).count() == 0
