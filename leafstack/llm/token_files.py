"""Token ids in seekable zstandard files.

A file holds documents in ascending id order. Its frames are independent
zstandard frames of little-endian unsigned 32-bit ids; a frame ends with a
document once it has ``FRAME_BYTES``, and a longer document is cut. The frame
before the last names the documents. The file ends with a seek table in the
public seekable format: a skippable frame with compressed size, raw size and
checksum (low 32 bits of XXH64 of the raw bytes) of every frame. A reader needs
the table, the index frame and the frames of the documents it was asked for.

Files are written by the tasks of one range-partitioned job. The index table
beside them is committed by Spark, so files of failed or doubled attempts are
never read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .arrow import bodies, releasing, slices
from .common import table

FRAME_BYTES = 1 << 18
END_ID = 2
SLICE_BYTES = 4 << 20
#: Bytes of remembered pieces of words and their codes; those of the last slice alone stay when there are more.
CACHED_BYTES = 8 << 20
#: Pieces given to the tokenizer at once.
LEARNED = 20_000
SUFFIX = ".tokens.zst"

# Fixed values of the public seekable zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

# Fixed value: how the vocabulary's pre-tokenizer cuts lower-case text, and its short forms.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT_FORMS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
NOT_LATIN = re.compile(r"[\u0250-\U0010ffff]|<\|")
ASCII_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


class Encoder:
    """Ids of texts as bytes, equal to encoding the whole text at once.

    White space always parts tokens here, so texts are cut at ASCII white
    space and each distinct word of a slice is encoded once. Latin words are
    cut as the pre-tokenizer does, and each distinct piece is encoded once, in
    large batches; all others, and words with special tokens, are pieces of
    their own and take the tokenizer's own way. Texts, words, pieces and codes
    are Arrow arrays, with no object per word of a text. Pieces and their codes
    are remembered up to ``cached`` bytes.
    """

    def __init__(self, path: str, cached: int = CACHED_BYTES):
        # The task has its core; threads would only add their own heaps.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer(self.whole.model)
        self.parts.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cached = cached
        self.forget()

    def forget(self) -> None:
        """Let go of all remembered pieces."""
        self.keys, self.codes = pa.array([], pa.string()), pa.array([], pa.large_binary())

    @property
    def held(self) -> int:
        """Bytes of the remembered pieces and their codes."""
        return self.keys.nbytes + self.codes.nbytes

    def _pieces(self, words: pa.Array) -> pa.Array:
        """The pieces of the words (binary) in order; a line end, as a piece of its own, follows each word."""
        data = _joined(words)
        if data.isascii() and b"<|" not in data:
            return _cut(data.lower())
        text = data.decode("utf-8", "replace")
        if _latin(text):
            return _cut(text.lower().encode())
        pieces, plain = [], []
        for word in text[:-1].split("\n"):
            if _latin(word):
                plain.append(word)
            else:
                pieces += [_cut("".join(f"{w}\n" for w in plain).lower().encode()), pa.array([word, "\n"])]
                plain = []
        return pa.concat_arrays([*pieces, _cut("".join(f"{w}\n" for w in plain).lower().encode())])

    def _learn(self, new: list[str]) -> pa.Array:
        """Codes of pieces."""
        codes, blank, latin = [b""] * len(new), _blank(), _latin("\n".join(new))
        plain = []
        for k, piece in enumerate(new):
            if latin or _latin(piece):
                if piece[0] not in blank:
                    plain.append(k)
            else:
                codes[k] = np.array(self.whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        for at in range(0, len(plain), LEARNED):
            some = plain[at:at + LEARNED]
            groups = [[new[k] for k in some[i:i + 500]] for i in range(0, len(some), 500)]
            coded = self.parts.encode_batch_fast(groups, add_special_tokens=False, is_pretokenized=True)
            flat = np.concatenate([np.array(e.ids, "<u4") for e in coded])
            stops = np.flatnonzero(self.ends[flat]) + 1
            if len(stops) != len(some):
                raise ValueError("a token of the vocabulary has no word end")
            start, raw = 0, flat.tobytes()
            for k, stop in zip(some, (stops * 4).tolist()):
                codes[k] = raw[start:stop]
                start = stop
        return pa.array(codes, pa.large_binary())

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, memoryview]:
        """Where each text's ids start and end in bytes, and all ids; ``texts`` is a binary array without NULLs."""
        words, firsts = _words(texts)
        words = words.dictionary_encode()
        pieces = self._pieces(words.dictionary).dictionary_encode()
        seen = pieces.dictionary
        at = pc.index_in(seen, self.keys)
        if at.null_count:
            unknown = np.asarray(at.is_null())
            at = np.asarray(at.fill_null(0)).copy()
            at[unknown] = len(self.keys) + np.arange(np.count_nonzero(unknown))
            new = seen.filter(pa.array(unknown))
            self.codes = pa.concat_arrays([self.codes, self._learn(new.to_pylist())])
            self.keys = pa.concat_arrays([self.keys, new])
        found = self.codes.take(pa.array(at))
        if self.held > self.cached:
            self.keys, self.codes = seen, found
            if self.held > self.cached:
                self.forget()
        offsets, raw = _contents(found.take(pieces.indices))
        stops = np.flatnonzero(np.asarray(pc.equal(pieces.indices, pc.index(seen, "\n")))) + 1
        by_word = pa.Array.from_buffers(
            pa.large_binary(), len(words.dictionary),
            [None, pa.py_buffer(np.concatenate([[0], offsets[stops]]).astype("i8")), pa.py_buffer(raw)])
        offsets, raw = _contents(by_word.take(words.indices))
        return offsets[firsts], raw

    def encode(self, texts: list[bytes]) -> list[bytes]:
        offsets, raw = self.encode_array(pa.array(texts, pa.binary()))
        return [bytes(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


# Classes of characters: white space, letters, those that stand alone (digits, and the line end after a word), others.
SPACE, LETTER, ALONE, OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every character up to U+2FFF, which holds the Latin ones and their lower case."""
    classes, every = np.full(0x3000, OTHER, "u1"), "".join(map(chr, range(0x3000)))
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (ALONE, r"\p{N}|\n")):
        classes[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return classes


@lru_cache(maxsize=1)
def _blank() -> frozenset:
    return frozenset([*map(chr, np.flatnonzero(_classes() == SPACE).tolist()), "\n"])


def _latin(text: str) -> bool:
    return not NOT_LATIN.search(text)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary) between ASCII white space, and the number of words before each text's end."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, "i4")[texts.offset:texts.offset + len(texts) + 1].astype("i8") if len(texts) else np.zeros(1, "i8")
    data = np.frombuffer(data or b"", "u1")[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    inside = ~ASCII_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    places = np.concatenate([np.cumsum(inside, dtype="i4")[at] - 1, [np.count_nonzero(inside)]]).astype("i4")
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(data[inside])])
    return words, np.searchsorted(at, offsets)


def _joined(words: pa.Array) -> bytes:
    """The words with a line end after each."""
    joined = pc.binary_join_element_wise(words, pa.scalar(b"\n"), pa.scalar(b""))
    return joined.buffers()[2].to_pybytes() if len(words) else b""


def _cut(data: bytes) -> pa.Array:
    """The pieces of lower-case Latin text as ``PRE_TOKEN`` cuts it; white space and line ends are pieces too."""
    chars = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
    if not len(chars):
        return pa.array([], pa.string())
    kinds = _classes()[chars]
    first = np.ones(len(chars) + 1, bool)
    first[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == ALONE)
    # an apostrophe that starts a piece takes the letters of a short form with it
    for form in SHORT_FORMS:
        here = np.flatnonzero(first[:-len(form)] & (chars[:len(chars) + 1 - len(form)] == ord("'")))
        for k, c in enumerate(form[1:], 1):
            here = here[chars[here + k] == ord(c)]
        first[here + 1] = False
        first[here + len(form)] = True
    sizes = 1 + (chars >= 0x80) + (chars >= 0x800)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype="i4")])[first].astype("i4")
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _contents(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets (from 0) and bytes of a large binary array that is not a slice."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, "i8", len(values) + 1) if len(values) else np.zeros(1, "i8")
    return offsets, memoryview(data if data is not None else b"")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder; what it remembers from task to task is bounded by bytes."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class FrameWriter:
    """Writes documents to an open binary file; ``close`` adds the index frame and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes, self.table = out, frame_bytes, []
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.held, self.held_bytes = [], 0
        self.ids, self.sizes = [], []

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.held_bytes = [], 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(raw) // 4)
        for at in range(0, len(raw), self.frame_bytes):
            piece = raw[at:at + self.frame_bytes]
            self.held.append(piece)
            self.held_bytes += len(piece)
            if self.held_bytes >= self.frame_bytes:
                self._flush()

    def close(self) -> None:
        self._flush()
        known = np.array([i is not None for i in self.ids], "u1")
        ids = np.array([i or 0 for i in self.ids], "<i8")
        self._frame(struct.pack("<Q", len(ids)) + ids.tobytes() + known.tobytes() + np.array(self.sizes, "<i8").tobytes())
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Reads documents by place from a file given as ``read(offset, length)`` and its length."""

    def __init__(self, read, length: int):
        self.read = read
        count, _, magic = struct.unpack("<IBI", read(length - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        self.table = np.frombuffer(read(length - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype("i8")
        self.places = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.starts = np.concatenate([[0], np.cumsum(self.table[:-1, 1])])
        self.unpacker, self.last = zstandard.ZstdDecompressor(), (None, b"")
        raw = self.frame(count - 1)
        n = struct.unpack("<Q", raw[:8])[0]
        self.ids = np.frombuffer(raw, "<i8", n, 8)
        self.known = np.frombuffer(raw, "u1", n, 8 + 8 * n)
        self.sizes = np.frombuffer(raw, "<i8", n, 8 + 9 * n)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = self.unpacker.decompress(self.read(int(self.places[k]), int(self.table[k, 0])))
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def pieces(self, i: int) -> Iterator[memoryview]:
        """The raw ids of document ``i``, from the frames that hold them only."""
        start, stop = int(self.offsets[i]) * 4, int(self.offsets[i + 1]) * 4
        k = int(np.searchsorted(self.starts, start, "right")) - 1
        while start < stop:
            raw, base = self.frame(k), int(self.starts[k])
            end = min(stop, base + len(raw))
            if end > start:
                yield memoryview(raw)[start - base:end - base]
                start = end
            k += 1


def write_tokens(
    documents: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, frame_bytes: int = FRAME_BYTES, seed: int = 42,
) -> DataFrame:
    """Write token files and their index to ``path``; returns the index.

    The index has one row per document: ``file, place, doc_id, n_tokens``.
    ``path`` must be readable and writable by all executors. Documents are in
    ascending id order over all files, NULL ids first, equal ids in the order
    of a hash of their text; NULL texts have the end id alone. Repeated rows
    are written as often as they come. An empty table gives an empty index.
    """
    ordered = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    ordered = bodies(ordered.sortWithinPartitions("doc_id", "tie"), "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{SUFFIX}"
        code, end, out, place = encoder(tokenizer), struct.pack("<I", end_id), None, 0
        for batch in slices(batches, "body", SLICE_BYTES):
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                writer = FrameWriter(out, frame_bytes)
            ids, sizes = batch.column("doc_id"), []
            offsets, raw = code.encode_array(batch.column("body"))
            for doc_id, start, stop in zip(ids.to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                writer.add(doc_id, bytes(raw[start:stop]) + end)
                sizes.append((stop - start) // 4 + 1)
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(sizes)), pa.array(range(place, place + len(sizes)), pa.int64()),
                ids.cast(pa.int64()), pa.array(sizes, pa.int64()),
            ], ["file", "place", "doc_id", "n_tokens"])
            place += len(sizes)
        if out is not None:
            writer.close()
            out.close()

    index = ordered.mapInArrow(releasing(write), "file string, place bigint, doc_id bigint, n_tokens bigint")
    index.write.parquet(f"{path}/index")
    return documents.sparkSession.read.parquet(f"{path}/index")


def _store(path: str):
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    Frames are checked while they are read; a damaged one fails the task.
    """
    index = spark.read.parquet(f"{path}/index")
    shards = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    starts, total = [], 0
    for k, row in enumerate(sorted(shards, key=lambda r: r["file"])):
        starts.append({"id": k, "file": row["file"], "base": total})
        total += row["n"]
    if not starts:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    # from Arrow, as rows of Python objects would pass through workers of their own
    shard_table = spark.createDataFrame(pa.Table.from_pylist(starts))
    # one task per file
    files = spark.range(0, len(starts), 1, len(starts)).join(F.broadcast(shard_table), "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(f"{folder}/{file}") as source:
                    reader = FrameReader(lambda at, n, f=source: f.read_at(n, at), source.size())
                    sums = []
                    for i in range(len(reader.ids)):
                        crc = 0
                        for piece in reader.pieces(i):
                            crc = zlib.crc32(piece, crc)
                        sums.append(crc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(reader.ids, mask=reader.known == 0), pa.array(reader.offsets[:-1] + base, pa.int64()),
                    pa.array(reader.sizes, pa.int64()), pa.array(sums, pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "base").mapInArrow(
        releasing(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the documents named in ``wanted`` (``doc_id``), opening their frames only."""
    index = spark.read.parquet(f"{path}/index")
    found = index.join(wanted.select("doc_id").distinct(), "doc_id").repartition("file").sortWithinPartitions("file", "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        name, reader = None, None
        for batch in batches:
            for file, place in zip(batch.column("file").to_pylist(), batch.column("place").to_pylist()):
                if file != name:
                    name, source = file, store.open_input_file(f"{base}/{file}")
                    reader = FrameReader(lambda at, n, f=source: f.read_at(n, at), source.size())
                ids = np.frombuffer(b"".join(reader.pieces(place)), "<u4").astype("i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(reader.ids[place])], pa.int64()), pa.array([ids], pa.list_(pa.int64()))],
                    ["doc_id", "ids"],
                )

    return found.select("file", "place").mapInArrow(releasing(read), "doc_id bigint, ids array<bigint>")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, path)


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
