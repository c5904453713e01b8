"""Operators without SQL against plain versions of their definitions, and inner parts at their edges."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafstack.llm import components, exact_dedup, licenses, llm_queries, mixing, simhash, suffix_dedup, token_files
from leafstack.llm.parsing import phrases
from leafstack.session import scratch_path

from .conftest import SF

TOKENS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


def closure(values, near):
    """The smallest index reachable from each."""
    label = np.arange(len(values))
    while True:
        least = np.where(near, label[None, :], len(values)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in llm_queries()["op2_simhash"](spark, SF).collect()}
    fps = np.array([plain_fingerprint(t) for _, t in documents], np.uint64)
    label = closure(fps, np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert got == {d: (f"{f:016x}", documents[k][0]) for (d, _), f, k in zip(documents, fps, label)}


@pytest.mark.parametrize("piece", [7, 40, 1000])
def test_shingles_over_pieces(piece):
    text = b"One  two three\nfour five six seven Eight nine ten " * 5
    whole = [h for part in simhash.shingle_hashes(text) for h in part]
    assert [h for part in simhash.shingle_hashes(text, piece=piece) for h in part] == whole and len(whole) == 48


@pytest.mark.parametrize("text", [
    b"abcdefghijkl b", b"aaaaaaaaa bbbbbbbbb\n", b"a" + b" " * 40, b" " * 40 + b"a", b"abcdefgh" * 3 + b"\n", b" " * 40, b"One two three" + b" " * 40,
])
def test_few_words_over_pieces(text):
    """A text of fewer words than a shingle has the hash of all its words, however many pieces it spans."""
    whole = [h for part in simhash.shingle_hashes(text) for h in part]
    assert len(whole) == (1 if text.strip() else 0)
    assert [h for part in simhash.shingle_hashes(text, piece=7) for h in part] == whole
    assert simhash.fingerprints_of([text]).any() == bool(whole)


def test_anchors_cover_one_bit():
    rng = np.random.default_rng(1)
    halves = np.concatenate([rng.integers(0, 1 << 32, 500, dtype=np.uint64), np.array([0, 1, 1 << 31, (1 << 32) - 1], np.uint64)])
    home, visits = simhash.anchors(halves)
    assert (visits == home[:, None]).any(axis=1).all() and np.bitwise_count(home.view(np.uint64) ^ halves).max() <= 1
    for bit in range(32):
        other, _ = simhash.anchors(halves ^ np.uint64(1 << bit))
        assert (visits == other[:, None]).any(axis=1).all()


@pytest.mark.parametrize("tile", [4, 4096])
def test_links_of_dense_and_crowded_fingerprints(spark, tile):
    """A dense ball, chains, and many fingerprints that share a half (one anchor in many tiles)."""
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 62))
    ball = [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))]
    half = [(int(x) << 32) | 77 for x in rng.integers(0, 1 << 30, 150)]
    chain = [int(sum(1 << k for k in range(n))) << 20 for n in range(0, 40, 3)]
    values = np.unique(np.array(ball + half + chain, np.uint64))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    links = simhash.near_links(nodes, tile_homes=tile)
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    signed = np.sort(values.view(np.int64))
    unsigned = signed.view(np.uint64)
    label = closure(signed, np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= 3)
    assert {int(v): got.get(int(v), int(v)) for v in signed} == {int(v): int(signed[k]) for v, k in zip(signed, label)}
    assert links.count() < 40 * len(values)


def test_components_of_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)] + [(-5, -9)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1100), 1000), -5: -9, -9: -9}


def test_token_files(spark, documents):
    whole = Tokenizer.from_file(TOKENS)
    expected, start = [], 0
    for doc_id, text in documents:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, llm_queries()["op4_token_files"](spark, SF).collect())) == expected


def test_encoder_equals_whole_texts():
    texts = ["It's NAÏVE — don't; l'ÉTÉ x\x1cy 3½²", "ΌΣΟΣ ὈΔΥΣΣΕΎΣ. İstanbul", "<|endoftext|> a <|endoftext|>b", "", " \n", "é e ́", "日本語 テキスト", "'s 've"]
    whole, code = Tokenizer.from_file(TOKENS), token_files.Encoder(TOKENS, cached=5)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in code.encode([t.encode() for t in texts])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_reading_single_documents(spark, documents):
    path = scratch_path(spark, "tokens")
    docs = spark.createDataFrame(documents, "doc_id bigint, text string")
    token_files.write_tokens(docs, path, TOKENS, frame_bytes=512)
    wanted = spark.createDataFrame([(d,) for d, _ in documents[::17]], "doc_id bigint")
    got = {r["doc_id"]: r["ids"] for r in token_files.read_documents(spark, path, wanted).collect()}
    whole = Tokenizer.from_file(TOKENS)
    assert got == {d: [*whole.encode(t, add_special_tokens=False).ids, 2] for d, t in documents[::17]}


def test_damaged_frame_is_found():
    import io

    out = io.BytesIO()
    writer = token_files.FrameWriter(out, 64)
    for i in range(9):
        writer.add(i, bytes(range(40)))
    writer.close()
    data = bytearray(out.getvalue())
    opened = []

    def read(at, n):
        opened.append(at)
        return bytes(data[at:at + n])

    reader = token_files.FrameReader(read, len(data))
    assert b"".join(reader.pieces(7)) == bytes(range(40)) and 0 not in opened
    data[reader.places[0] + 12] ^= 255
    with pytest.raises(Exception):
        list(token_files.FrameReader(read, len(data)).pieces(0))


def plain_words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())]


def test_license_phrases(spark, documents):
    got = {r["doc_id"]: r for r in llm_queries()["op5_license_scan"](spark, SF).collect()}
    for doc_id, text in documents:
        words, places = plain_words(text), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places.sort()
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))


def test_license_texts_with_changes(spark):
    mit = licenses.TEXTS["mit"].split()
    changed = " ".join(["intro"] * 300 + mit[:9] + ["and", "so", "on"] + mit[9:20] + mit[21:] + ["end"] * 300)
    scattered = " ".join(w for x in mit for w in (x, "and", "then"))
    rows = [(1, licenses.TEXTS["bsd"]), (2, changed), (3, scattered), (4, "Under the MIT License under the mit license. CC BY-NC"), (5, " ".join(mit[:8]))]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i]["labels"] for i in range(1, 6)] == ["bsd", "mit", "", "cc-by-nc,mit", ""]
    assert got[1]["score"] == 1.0 and 0.5 < got[2]["score"] < 1 and got[4]["n_base"] == 3 and got[4]["base_labels"] == "cc-by-nc,mit"


def test_exact_duplicates_with_colliding_keys(spark):
    texts = ["", "a", "b", "a" * 16, "b" * 16, "a" * 17, "a" * 16 + "b" * 16, "b" * 16 + "a" * 16, "a" * 16, "ab" * 50, "ab" * 50, "a" * 64]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    named = exact_dedup.identities(docs, block_bytes=16, key=lambda b: F.pmod(F.xxhash64(b), F.lit(2)))
    got = {r["doc_id"]: (r["level"], r["name"]) for r in named.collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (a == b)


def test_mixing_with_weights_and_caps(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}" if i % 11 else None, 1.0 + (i % 3) * 4) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, weight double")
    got = mixing.mix(docs, weight_col="weight").toPandas().merge(docs.toPandas(), on="doc_id")
    assert (got.taken <= 2 * got["size"]).all() and got.target.gt(0).all()
    for _, part in got.groupby("source", dropna=False):
        assert abs(part.taken.sum() - min(part.target.iloc[0], 2 * part["size"].sum())) <= 7
    copies = got.groupby("weight").copies.mean()
    assert copies.is_monotonic_increasing and copies.iloc[-1] > copies.iloc[0]


def test_mixing_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FINE_ROWS", 3)
    monkeypatch.setattr(mixing, "BINS", 4)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).toPandas()
    for _, part in got.groupby("target"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 9


def test_phrases_hold_every_string_once():
    for trial in range(100):
        rng = np.random.default_rng(trial)
        docs = [bytes(rng.integers(97, 99 + trial % 3, rng.integers(0, 40)).astype(np.uint8)) for _ in range(6)]
        block, ends = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([len(d) for d in docs])
        row, start, stop, at, trigger, name = phrases(block, ends, 10, 4)
        found = [(int(r), s) for r, a, b in zip(row, start, stop) for s in range(a, b - 9)]
        assert sorted(found) == [(i, s + int(ends[i]) - len(d)) for i, d in enumerate(docs) for s in range(len(d) - 9)]
        marks, names = {}, {}
        for a, b, t, h, n in zip(start, stop, at, trigger, name):
            names.setdefault((int(h), int(n)), set()).add(bytes(block[a:b]))
            for s in range(a, b - 9):
                marks.setdefault(bytes(block[s:s + 10]), set()).add((int(t - s), int(h)))
        assert all(len(v) == 1 for v in [*marks.values(), *names.values()])


@pytest.mark.parametrize("hot", [None, 10**6])
def test_substrings(spark, hot):
    """Small alphabets, copies and periodic texts; once with all triggers dealt out as usual, once with hot ones."""
    rng = np.random.default_rng(4)
    docs = ["".join(rng.choice(list("abé"), rng.integers(0, 120))) for _ in range(60)]
    docs += [docs[3], docs[3] + docs[5], "ab" * 90, "ba" * 70 + docs[5][:30], "x" * 200, "", docs[7][5:60] * 3] + [d[10:80] for d in docs[:20]]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_dedup.dedup_substrings(
        frame, length=12, trigger=4, hot_partitions=hot, sample=1).collect()}
    seen, expected = {}, {}
    raw = [d.encode() for d in docs]
    for i, d in enumerate(raw):
        for s in range(len(d) - 11):
            seen.setdefault(d[s:s + 12], i)
    for i, d in enumerate(raw):
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - 11):
            if seen[d[s:s + 12]] < i:
                gone[s:s + 12] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        expected[i] = (len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~gone[:-1]]))
    assert got == expected


def test_sweep_over_any_batches():
    """The sweep finds the same in one batch as in batches of one row."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = np.unique(np.stack([rng.integers(0, 6, 80), rng.integers(0, 3, 80), rng.integers(0, 5, 80)], 1), axis=0)

    def batch(part):
        n = len(part)
        return pa.RecordBatch.from_arrays([
            pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(part[:, 2]), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n) * 0),
            pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, np.int8))], list(suffix_dedup._Sweep.NAMES))

    def run(parts):
        sweep, out = suffix_dedup._Sweep(), ([], [])
        for part in parts:
            for store, x in zip(out, sweep.take(batch(part))):
                store.extend(zip(x["trigger"].tolist(), x["name"].tolist(), x["doc"].tolist()))
        return [sorted(x) for x in out]

    assert run([rows]) == run([rows[i:i + 1] for i in range(len(rows))]) == run([rows[:33], rows[33:]])
