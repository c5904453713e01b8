"""Vectorised Python functions: where a user's parser, chunker or model plugs in."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from ..defaults import CHUNK_OVERLAP, CHUNK_SIZE, EMBED_BATCH, EMBED_BUCKETS
from ..schemas import PAGE_STRUCTS

#: Of an Arrow batch, so many bytes are Python objects at a time.
PIECE_BYTES = 2 * 1024 * 1024
_TOKEN_BREAK = r"[^\p{L}\p{N}]+"
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_MD5_MIXES = (
    lambda b, c, d: d ^ (b & (c ^ d)), lambda b, c, d: c ^ (d & (b ^ c)),
    lambda b, c, d: b ^ c ^ d, lambda b, c, d: c ^ (b | ~d),
)
_SENTENCE_BREAK = re.compile(r"(?<=[.!?])[ \t\n\r\f\v]+")


def _md5_heads(tokens: pa.LargeStringArray) -> np.ndarray:
    """The first 32 bits of the MD5 of each token, -1 for an empty one.

    Tokens that fit one block of the digest are hashed together, a column of
    numbers for each of its words.
    """
    out = np.full(len(tokens), -1, np.int64)
    if not len(tokens):
        return out
    ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends)
    for i in np.flatnonzero(sizes > 55):
        out[i] = int(hashlib.md5(data[ends[i]:ends[i + 1]].tobytes()).hexdigest()[:8], 16)
    some = np.flatnonzero((sizes > 0) & (sizes <= 55))
    sizes, at = sizes[some], np.arange(len(some))
    row = np.repeat(at, sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = np.zeros((len(some), 64), np.uint8)
    block[row, place] = data[ends[some][row] + place]
    block[at, sizes] = 0x80
    word = np.ascontiguousarray(block.view("<u4").T)
    word[14] = sizes * 8
    a, b, c, d = (np.full(len(some), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        kind = i // 16
        mixed = _MD5_MIXES[kind](b, c, d) + a + _MD5_SINES[i] + word[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        turn = _MD5_TURNS[kind][i % 4]
        a, b, c, d = d, b + (mixed << turn | mixed >> (32 - turn)), b, c
    out[some] = (a + np.uint32(0x67452301)).byteswap()
    return out


def hash_embed(texts: Sequence[str], buckets: int = EMBED_BUCKETS) -> list[np.ndarray]:
    """Stand-in for a model: hashed token counts, scaled to unit length.

    Tokens are found and encoded by Arrow; each distinct one is hashed once, all at a time.
    """
    lower = pc.utf8_lower(pa.array(["" if t is None else t for t in texts], pa.large_string()))
    lists = pc.split_pattern_regex(lower, _TOKEN_BREAK)
    row = pc.list_parent_indices(lists).to_numpy()
    coded = pc.list_flatten(lists).dictionary_encode()
    number = _md5_heads(coded.dictionary)
    slot = np.where(number < 0, -1, number % buckets)[coded.indices.to_numpy()]
    row, slot = row[slot >= 0], slot[slot >= 0]
    counts = np.bincount(row * buckets + slot, minlength=len(texts) * buckets).astype(float)
    counts = counts.reshape(len(texts), buckets)
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    return list(np.divide(counts, norm, out=counts, where=norm > 0).astype(np.float32))


def _pieces(batches: Iterator[pa.Array]) -> Iterator[list]:
    """The values in order as Python objects, about ``PIECE_BYTES`` of them at a time (one at least)."""
    for values in batches:
        step = max(1, len(values) * PIECE_BYTES // max(1, values.nbytes))
        for start in range(0, len(values), step):
            yield values.slice(start, step).to_pylist()


def embedding_udf(
    fn: Callable[[Sequence[str]], Sequence] = hash_embed, batch_size: int = EMBED_BATCH
):
    """Iterator function; ``fn`` sees at most ``batch_size`` texts at a time.

    Order is kept and an error of ``fn`` fails the task. It is marked as not
    deterministic, so that a filter on the vector does not run it a second time.
    """
    vectors = pa.list_(pa.float32())

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            parts = [
                pa.array(list(fn(contents.slice(start, batch_size).to_pylist())), vectors)
                for start in range(0, len(contents), batch_size)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], vectors)

    return embed.asNondeterministic()


def chunker_udf(chunker: Callable[[str], list[str]]):
    """Iterator function: text to chunks; a NULL text has none."""

    @F.arrow_udf(ArrayType(StringType()))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _pieces(batches):
            yield pa.array([[] if t is None else list(chunker(t)) for t in texts], pa.list_(pa.string()))

    return split


def parser_udf(parser: Callable[[object], list[tuple]]):
    """Iterator function: file content to ``(title, page_number, text)`` rows.

    A document that fails gives NULL, so that the others go on.
    """
    rows = pa.list_(pa.struct([("title", pa.string()), ("page_number", pa.int32()), ("text", pa.string())]))

    def guarded(content):
        try:
            return [
                {"title": title, "page_number": int(number), "text": text} for title, number, text in parser(content)
            ]
        except Exception:
            return None

    @F.arrow_udf(PAGE_STRUCTS)
    def pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in _pieces(batches):
            yield pa.array([guarded(c) for c in contents], rows)

    return pages


def parser_error_udf(parser: Callable[[object], list[tuple]]):
    """Iterator function: what went wrong with a file's content, NULL if it was parsed."""

    def error(content):
        try:
            for _, number, _ in parser(content):
                int(number)
        except Exception as e:
            return f"{type(e).__name__}: {e}"
        return None

    @F.arrow_udf("string")
    def errors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in _pieces(batches):
            yield pa.array([error(c) for c in contents], pa.string())

    return errors


def sentence_chunks(
    text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> list[str]:
    """Pack sentences greedily into chunks of at most ``size`` words.

    A new chunk starts with the closing sentences of the one before, as many
    as fit into ``overlap`` words, unless the next sentence would then no
    longer fit. Sentences above ``size`` words are cut first.
    """
    units: list[list[str]] = []
    for sentence in _SENTENCE_BREAK.split(text):
        tokens = sentence.split()
        units.extend(tokens[i:i + size] for i in range(0, len(tokens), size))
    total = np.concatenate([[0], np.cumsum([len(u) for u in units], dtype=np.int64)])
    chunks = []
    start = fresh = 0
    while fresh < len(units):
        if total[fresh + 1] - total[start] > size:
            start = fresh
        stop = int(np.searchsorted(total, total[start] + size, side="right")) - 1
        chunks.append(" ".join(w for u in units[start:stop] for w in u))
        fresh = stop
        start = int(np.searchsorted(total, total[stop] - overlap, side="left"))
    return chunks
