"""The token encoder keeps a bounded number of bytes, tasks release what they free, and files are read back by ranges."""

import random
import re
from pathlib import Path
from unittest import mock

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from tokenizers import Tokenizer

from leafstack.llm import token_files
from leafstack.llm.arrow import releasing
from leafstack.operators.skew import number_rows
from leafstack.session import scratch_path

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def test_remembered_bytes_stay_under_their_bound():
    whole, code = Tokenizer.from_file(TOKENS), token_files.Encoder(TOKENS, cached=40_000)
    for k in range(4):
        texts = [" ".join(f"w{chr(97 + k)}{i}x" for i in range(j, j + 400)) for j in range(0, 4000, 400)]
        got = [np.frombuffer(b, "<u4").tolist() for b in code.encode([t.encode() for t in texts])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert code.held <= 40_000


def test_pieces_known_from_other_words_are_not_encoded_again():
    code, given = token_files.Encoder(TOKENS), []
    learn = code._learn
    with mock.patch.object(code, "_learn", lambda new: given.extend(new) or learn(new)):
        code.encode([b"Tokens, tokens. (TOKENS) tokens' token", b"token's tokens;"])
        code.encode([b"(tokens' TOKEN"])
    assert sorted(given) == sorted({"tokens", "token", ",", ".", "(", ")", "'", "'s", ";", "\n"})


def test_cut_is_the_pre_tokenizers():
    rnd = random.Random(1)
    chars = "aB's'tréveLL'm'd19²½.,!?-_\x1c\x85\xa0İȺƁẞß<|>"
    for _ in range(1000):
        word = "".join(rnd.choices(chars, k=rnd.randint(1, 14))).lower()
        got = [p for p in token_files._cut(f"{word}\n".encode()).to_pylist() if p[0] not in token_files._blank()]
        assert got == regex.findall(token_files.PRE_TOKEN, word)


def test_random_texts_equal_the_tokenizer():
    rnd, whole, code = random.Random(2), Tokenizer.from_file(TOKENS), token_files.Encoder(TOKENS, cached=3000)
    chars = [*"aB's'tréveLL'm'd19²½.,-\x1c\x85\xa0İẞ<|>Σς日\u0301😀", " ", " ", "\t", "\n", "<|endoftext|>", "word "]
    for _ in range(150):
        texts = ["".join(rnd.choices(chars, k=rnd.randint(0, 60))) for _ in range(rnd.randint(0, 9))]
        got = [np.frombuffer(b, "<u4").tolist() for b in code.encode([t.encode() for t in texts])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_digests_load_no_file_whole(spark):
    path = scratch_path(spark, "tokens")
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id bigint, text string")
    token_files.write_tokens(docs, path, TOKENS, frame_bytes=64)
    digests = token_files.token_digests(spark, path)
    assert "binaryFile" not in digests._jdf.queryExecution().toString()
    assert sorted(r["doc_id"] for r in digests.collect()) == list(range(50))


def _resident():
    """MB of this process's own memory."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_a_task_gives_freed_memory_back():
    pins = []

    def work(batches):
        blocks = [np.ones(50_000, "u1") for _ in range(4000)]
        pins.append(np.ones(50_000, "u1"))  # above the blocks, so that the heap cannot shrink by itself
        blocks.clear()
        yield from batches

    before = _resident()
    assert len(list(releasing(work)(iter([pa.RecordBatch.from_pydict({"x": [1]})])))) == 1
    assert _resident() - before < 60


def test_a_worker_remembers_few_megabytes():
    code = token_files.Encoder(TOKENS)
    for k in range(6):
        code.encode([" ".join(f"{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}q" for i in range(60_000)).encode()])
        assert code.held <= 8 << 20


def test_small_tables_need_no_python_worker(spark):
    path = scratch_path(spark, "tokens")
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id bigint, text string")
    token_files.write_tokens(docs, path, TOKENS)
    docs = docs.repartition(4)
    with mock.patch.object(type(spark.sparkContext), "parallelize", side_effect=AssertionError):
        digests, numbered = token_files.token_digests(spark, path), number_rows(docs, ["doc_id"], "n", 5)
        assert sorted((r["doc_id"], r["n"]) for r in numbered.collect()) == [(i, i + 5) for i in range(50)]
        assert number_rows(docs.filter("doc_id < 0"), ["doc_id"], "n").count() == 0
        assert digests.count() == 50
