"""Cross-tokenizer alignment by an as-of merge per batch.

Each text is encoded by two public tokenizers: A (byte-level BPE, on a space
and the text) and B (sentencepiece BPE, which adds the space itself). Token
bytes are A's vocabulary entry decoded from its byte alphabet, and B's piece
in UTF-8 with U+2581 as a space and ``<0xHH>`` as byte HH. A text whose A or
B bytes, joined, are not the space and the text gets no tokens.

Within an Arrow batch (bounded by bytes) all tokens of all documents form two
frames; ``pandas.merge_asof`` by document and offset, as one ascending key,
finds for every token start the other side's token that covers it, in both
directions. Two byte ranges
overlap exactly when one starts inside the other, so the union of both merges
is every overlapping (A, B) pair. Offsets where an A and a B token both end
cut the text into groups.

Spark then counts, over all documents, how many documents hold each id pair
linked (pre-aggregated per task), finds each A id's highest count and joins
both back to the documents' links.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrow import slices
from .common import landed, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The same vocabulary as A's, as ranks: ids are equal (tested against A), and encoding is some three times faster.
A_RANKS = "byte_bpe_50k.tiktoken"
SLICE_BYTES = 1 << 20
LINKS = "array<struct<a:int,b:int,n:int>>"
OUT = f"n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links {LINKS}"
# Fixed values of the public formats: sentencepiece's space mark and byte pieces.
SPACE_MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: Fixed values of the contract's group format: within a side, between sides, between groups, at the end.
SEPARATORS = pa.array([",", "|", ";", ""])


def byte_alphabet() -> dict[str, int]:
    """The byte-level BPE alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars, extra = {b: b for b in kept}, 0
    for b in range(256):
        if b not in chars:
            chars[b] = 256 + extra
            extra += 1
    return {chr(c): b for b, c in chars.items()}


@lru_cache(maxsize=1)
def tokenizer_a(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    alphabet = byte_alphabet()
    size = tok.get_vocab_size(with_added_tokens=True)
    pieces = [b""] * size
    for text, i in tok.get_vocab(with_added_tokens=True).items():
        pieces[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
    return tok, _table(pieces)


@lru_cache(maxsize=1)
def ranked_a(path: str):
    """A's vocabulary as a tiktoken encoding, with the split pattern that goes with it; no special tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def tokenizer_b(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        hexed = BYTE_PIECE.fullmatch(piece) if sp.is_byte(i) else None
        pieces.append(bytes([int(hexed.group(1), 16)]) if hexed else piece.replace(SPACE_MARK, " ").encode())
    return sp, _table(pieces)


def _tokens(ids: np.ndarray, table: tuple, target: bytes) -> np.ndarray | None:
    """Token ends, or None when the tokens' bytes are not the target; bytes are gathered from one buffer."""
    _, sizes, flat, first = table
    lengths = sizes[ids]
    ends = np.cumsum(lengths)
    if not len(ids) or ends[-1] != len(target):
        return None if len(ids) or target else ends
    shift = np.repeat(first[ids] - (ends - lengths), lengths)
    if not np.array_equal(flat[shift + np.arange(ends[-1])], np.frombuffer(target, np.uint8)):
        return None
    return ends


def _table(pieces: list[bytes]) -> tuple:
    """Pieces, their sizes, all their bytes in one buffer and where each starts in it."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return pieces, sizes, np.frombuffer(b"".join(pieces), np.uint8), first


def _frame(docs: list[int], ids: list[np.ndarray], ends: list[np.ndarray], offsets: np.ndarray) -> pd.DataFrame:
    """Tokens of all texts: ``start`` counts bytes from the batch's first text, so it ascends without a sort."""
    lengths = [len(e) for e in ends]
    starts = np.concatenate([np.concatenate([[0], e[:-1]]) for e in ends]) + np.repeat(offsets, lengths)
    return pd.DataFrame({
        "doc": np.repeat(np.asarray(docs, np.int64), lengths), "start": starts, "id": np.concatenate(ids),
    })


def _groups(fa: pd.DataFrame, ends_a: np.ndarray, fb: pd.DataFrame, ends_b: np.ndarray) -> tuple[list[int], list[memoryview]]:
    """Of all texts at once: how many groups each has, and its groups as ``a1,a2|b1;a3|b2,b3`` in UTF-8.

    Ends count from the batch's first text, and ascend; every group has tokens of both sides.
    """
    # the last tokens of groups end where the other side's tokens end too
    stop_a, stop_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
    stop_a[ends_a], stop_b[ends_b] = True, True
    last_a, last_b = stop_b[ends_a], stop_a[ends_b]
    # the group of a token is the number of groups closed before it; a group's A tokens stand before its B tokens
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n_groups = int(group_a[-1]) + 1
    per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    at_a = np.arange(len(group_a)) + (np.cumsum(per_b) - per_b)[group_a]
    at_b = np.arange(len(group_b)) + np.cumsum(per_a)[group_b]
    ids, code = np.empty(len(at_a) + len(at_b), np.int32), np.zeros(len(at_a) + len(at_b), np.int8)
    ids[at_a], ids[at_b] = fa["id"].to_numpy(), fb["id"].to_numpy()
    code[at_a[last_a]], code[at_b[last_b]] = 1, 2
    # the last token of each text has no separator
    docs = fb["doc"].to_numpy()
    text_end = np.append(docs[1:] != docs[:-1], True)
    stops = at_b[text_end]
    code[stops] = 3
    # each id with its separator is looked up by one number; Arrow holds the values' bytes one after the other
    joined = _numbers().take(pa.array(ids * np.int32(4) + code))
    offsets = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)
    raw, cuts = joined.buffers()[2], offsets[np.concatenate([[0], stops + 1])].tolist()
    counts = np.diff(np.concatenate([[0], group_b[text_end] + 1])).tolist()
    return counts, [memoryview(raw)[x:y] for x, y in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def _numbers() -> pa.Array:
    """Every 16-bit id followed by every separator, at ``4 * id + separator``."""
    ids = pc.cast(pa.array(np.repeat(np.arange(1 << 16, dtype=np.int32), len(SEPARATORS))), pa.string())
    return pc.binary_join_element_wise(ids, SEPARATORS.take(pa.array(np.tile(np.arange(len(SEPARATORS)), 1 << 16))), "")


def align_batch(
    texts: list[str | None], a_path: str, b_path: str, ranks_path: str | None = None,
) -> tuple[list[tuple], pd.DataFrame]:
    """Per text ``(n_a, n_b, n_groups, n_links, groups_sha256)``, and the distinct linked id pairs of all texts.

    The pairs (``doc, id_a, id_b, n``: text, ids, occurrences) are sorted by text.
    """
    tok_a, table_a = tokenizer_a(a_path)
    sp, table_b = tokenizer_b(b_path)
    assert max(len(table_a[0]), len(table_b[0])) <= 1 << 16, "pair keys hold ids of 16 bits"
    live = [k for k, t in enumerate(texts) if t]
    spaced = [" " + texts[k] for k in live]
    if ranks_path:
        enc_a = ranked_a(ranks_path).encode_ordinary_batch(spaced, num_threads=1) if live else []
    else:
        enc_a = [e.ids for e in tok_a.encode_batch(spaced, add_special_tokens=False)] if live else []
    enc_b = sp.encode([texts[k] for k in live], num_threads=1) if live else []
    out: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
    none = pd.DataFrame({"doc": np.zeros(0, np.int64), "id_a": np.zeros(0, np.int64), "id_b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    docs, a_ids, a_ends, b_ids, b_ends = [], [], [], [], []
    for k, ea, eb in zip(live, enc_a, enc_b):
        target = (" " + texts[k]).encode()
        ea, eb = np.asarray(ea, np.int64), np.asarray(eb, np.int64)
        ends_a, ends_b = _tokens(ea, table_a, target), _tokens(eb, table_b, target)
        if ends_a is None or ends_b is None or not len(ends_a):
            continue
        docs.append(k)
        a_ids.append(ea)
        a_ends.append(ends_a)
        b_ids.append(eb)
        b_ends.append(ends_b)
    if not docs:
        return out, none
    offsets = np.concatenate([[0], np.cumsum([e[-1] for e in a_ends])[:-1]])
    fa, fb = _frame(docs, a_ids, a_ends, offsets), _frame(docs, b_ids, b_ends, offsets)
    # Starts count from the batch's first text and every text's first tokens start together, so the
    # last start at or before a token is one of its own document: the key names the document as well.
    a_in_b = pd.merge_asof(fa, fb, on="start", suffixes=("_a", "_b"))
    b_in_a = pd.merge_asof(fb, fa.assign(start_a=fa["start"]), on="start", suffixes=("_b", "_a"))
    # A pair whose tokens start together is found from both sides; keep it once.
    fresh = b_in_a["start"].to_numpy() != b_in_a["start_a"].to_numpy()
    link_docs = np.concatenate([fa["doc"].to_numpy(), fb["doc"].to_numpy()[fresh]])
    link_a = np.concatenate([a_in_b["id_a"].to_numpy(), b_in_a["id_a"].to_numpy()[fresh]])
    link_b = np.concatenate([a_in_b["id_b"].to_numpy(), b_in_a["id_b"].to_numpy()[fresh]])
    n_links = np.bincount(link_docs, minlength=len(texts))
    # one key per (text, A id, B id): ids fit in 16 bits each
    key, n = np.unique((link_docs << 32) | (link_a << 16) | link_b, return_counts=True)
    pairs = pd.DataFrame({"doc": key >> 32, "id_a": (key >> 16) & 0xFFFF, "id_b": key & 0xFFFF, "n": n})
    stops_a, stops_b = (np.concatenate([e + o for e, o in zip(ends, offsets)]) for ends in (a_ends, b_ends))
    for d, ids_a, ids_b, n_groups, groups in zip(docs, a_ids, b_ids, *_groups(fa, stops_a, fb, stops_b)):
        out[d] = (len(ids_a), len(ids_b), n_groups, int(n_links[d]), hashlib.sha256(groups).hexdigest())
    return out, pairs


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, ranks_path: str | None) -> Iterator[pa.RecordBatch]:
    # A task has its cores; the tokenizer's own thread pool would only contend for them.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    for batch in slices(batches, "text", SLICE_BYTES):
        texts = batch.column("text").to_pylist()
        rows, pairs = align_batch(texts, a_path, b_path, ranks_path)
        offsets = np.searchsorted(pairs["doc"].to_numpy(), np.arange(len(texts) + 1), side="left").astype(np.int32)
        links = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
            [pa.array(pairs[c].to_numpy().astype(np.int32)) for c in ("id_a", "id_b", "n")], names=["a", "b", "n"]))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "row": batch.column("row"),
            "n_a": pa.array([r[0] for r in rows], pa.int64()), "n_b": pa.array([r[1] for r in rows], pa.int64()),
            "n_groups": pa.array([r[2] for r in rows], pa.int64()), "n_links": pa.array([r[3] for r in rows], pa.int64()),
            "groups_sha256": pa.array([r[4] for r in rows], pa.string()),
            "links": links,
        })


def alignments(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    a_path: str | None = None, b_path: str | None = None, ranks_path: str | None = "",
) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (all counts long).

    A link's count is the number of rows (documents) that hold its id pair
    linked; ``n_best`` counts links whose count is the highest of their A id
    (ties included), ``count_sum`` sums the counts over the links. NULL,
    empty and unmatched texts have zeros and ``groups_sha256 = ''``. NULL
    ids are kept; repeated rows count as separate documents; long texts are
    encoded whole. An empty table gives no rows; other columns are ignored.
    """
    a_path = a_path or public_tokenizers.path(A_FILE)
    # the ranks of A's vocabulary encode A; None keeps the tokenizers library for A
    ranks_path = public_tokenizers.path(A_RANKS) if ranks_path == "" else ranks_path
    b_path = b_path or public_tokenizers.path(B_FILE)
    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, row long, {OUT}"
    done = landed(rows.mapInArrow(lambda it: _aligned(it, a_path, b_path, ranks_path), schema), "aligned")
    # one number names a pair, so that rows are narrow and hash at once
    links = done.select("row", F.explode("links").alias("l")).select(
        "row", (F.shiftleft(F.col("l.a").cast("long"), 32) + F.col("l.b")).alias("pair"), "l.n")
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("docs")).withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("docs").alias("best"))
    info = counts.join(best, "a").select("pair", "docs", (F.col("docs") == F.col("best")).alias("top"))
    # the many links stream past the distinct pairs of their partition, unsorted
    per_row = links.join(info.hint("shuffle_hash"), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("n") * F.col("docs")).cast("long").alias("count_sum"),
    )
    return done.drop("links").join(per_row, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256",
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the two public tokenizers over all documents."""
    return alignments(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
