"""Substring dedup by prefix-free parsing.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id.

Texts are parsed at rolling-hash triggers into phrases (``parsing.phrases``):
every string of the length has its own trigger, and the strings of one trigger
form a phrase. Equal strings lie in phrases with equal trigger bytes. So the
corpus order of all strings is never sorted as a whole:

1. Parse. Phrases are named by hashes. Within a block the phrases of one
   name keep their smallest document; the strings of the others are settled.
2. The parse is dealt out by trigger. A phrase with an earlier document of the
   same name goes. Triggers with several phrases give the dictionary: their
   phrases, each in its earliest document.
3. The dictionary's suffixes are put in order trigger by trigger, as far as
   ``LENGTH`` bytes; a suffix equal to one of an earlier document goes.

Only names travel in step 2; texts of the dictionary's phrases, a small part
of the corpus, in step 3. A trigger that would fill half a partition by itself
(found by parsing a sample first; this decides the plan, not the result) is
dealt out by phrase in step 2 and by suffix in step 3, where the least document
is found by an aggregate and a join that Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrow import bodies, slices
from .common import landed, release, table
from .parsing import Hashes, phrases

LENGTH = 50
TRIGGER = 16
SLICE_BYTES = 2 << 20
#: Overlapping places of one phrase in a document are one row up to so many bytes.
RUN_BYTES = 4096
SAMPLE = 32
GROUP_BYTES = 4 << 20
PASS_ROWS = 2_000_000
LAST = (1 << 63) - 1

PARSE = "trigger bigint, name bigint, doc bigint, rep int, start bigint, stop bigint, kind tinyint"
SETTLED, PHRASE, HOT = 1, 0, 2


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, rep, body``: ids with NULL last, and a number that tells texts of one id apart (0 where ids are unique)."""
    rows = bodies(documents, id_col, text_col, F.xxhash64(text_col).alias("text_key")).select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), "text_key", "body"
    )
    doubled = documents.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc")).groupBy("doc").count().filter("count > 1")
    if doubled.isEmpty():
        return rows.select("doc", F.lit(0).alias("rep"), "body")
    texts = rows.join(doubled, "doc", "left_semi").select("doc", "text_key").distinct()
    texts = landed(texts.select("doc", "text_key", F.hash("text_key").alias("rep")), "rep")
    return rows.join(texts, ["doc", "text_key"], "left").select("doc", F.coalesce("rep", F.lit(0)).alias("rep"), "body")


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, most: int = 1 << 62):
    """Sorted intervals with overlapping ones of a document joined, up to ``most`` bytes from where one starts."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    base = np.int64(int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + doc * base) if int(doc.max()) < (1 << 62) // int(base) else None
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] + doc[1:] * base > reach[:-1])
    fresh[1:] |= start[1:] // most != start[:-1] // most
    first = np.flatnonzero(fresh)
    return doc[first], start[first], np.maximum.reduceat(stop, first)


def _parse(rows: DataFrame, length: int, trigger: int, hot: np.ndarray) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", SLICE_BYTES):
            texts = batch.column("body").to_pylist()
            ids, reps = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("rep").to_numpy(zero_copy_only=False)
            ends = np.cumsum([len(t) for t in texts])
            base = ends - [len(t) for t in texts]
            row, start, stop, _, ah, name = phrases(np.frombuffer(b"".join(texts), np.uint8), ends, length, trigger)
            if not len(row):
                continue
            order = np.lexsort((start, row, ids[row], name, ah))
            row, start, stop, ah, name = (x[order] for x in (row, start, stop, ah, name))
            fresh = np.concatenate([[True], (ah[1:] != ah[:-1]) | (name[1:] != name[:-1])])
            least = ids[row[np.flatnonzero(fresh)]][np.cumsum(fresh) - 1]
            own = ids[row] == least
            gone = _merged(row[~own], start[~own], stop[~own])
            # places of one phrase in one text that overlap are one row
            row, start, stop, ah, name, fresh = (x[own] for x in (row, start, stop, ah, name, fresh))
            again = np.zeros(len(row), bool)
            again[1:] = ~fresh[1:] & (row[1:] == row[:-1]) & (start[1:] < stop[:-1]) & (start[1:] // RUN_BYTES == start[:-1] // RUN_BYTES)
            first = np.flatnonzero(~again)
            stop = np.maximum.reduceat(stop, first)
            row, start, ah, name = row[first], start[first], ah[first], name[first]
            kind = np.where(np.isin(ah, hot), HOT, PHRASE) if len(hot) else np.full(len(row), PHRASE)
            both = np.concatenate([row, gone[0]])
            n = len(gone[0])
            away = (ids[gone[0]].view(np.uint64) + gone[1].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ah, away]).view(np.int64)), pa.array(np.concatenate([name, np.zeros(n, np.uint64)]).view(np.int64)),
                pa.array(ids[both]), pa.array(reps[both].astype(np.int32)),
                pa.array(np.concatenate([start, gone[1]]) - base[both]), pa.array(np.concatenate([stop, gone[2]]) - base[both]),
                pa.array(np.concatenate([kind, np.full(n, SETTLED)]).astype(np.int8)),
            ], ["trigger", "name", "doc", "rep", "start", "stop", "kind"])

    return rows.mapInArrow(read, PARSE)


def _hot_triggers(rows: DataFrame, length: int, trigger: int, partitions: int, sample: int) -> np.ndarray:
    """Triggers with over half a partition's share of the phrases of a sample of documents; at most 2 per partition."""
    some = _parse(rows.filter(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(sample)) == 0), length, trigger, np.zeros(0, np.uint64))
    counts = some.filter(F.col("kind") == PHRASE).groupBy("trigger").count().filter("count > 20")
    counts = landed(counts, "triggers")
    total = landed(some.agg(F.count(F.lit(1)).alias("n")), "total").first()["n"]
    hot = counts.filter(F.col("count") > total / (2 * partitions)).select("trigger").toArrow().column("trigger").to_numpy()
    return np.sort(hot.astype(np.int64)).view(np.uint64)


class _Sweep:
    """Reads the parse in order of trigger, phrase and document; keeps a few rows of the trigger at a batch's end."""

    NAMES = ("trigger", "name", "doc", "rep", "start", "stop", "kind")

    def __init__(self):
        self.kept = None

    def take(self, batch: pa.RecordBatch):
        x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in self.NAMES}
        settled_ = x["kind"] == SETTLED
        away = {n: v[settled_] for n, v in x.items()}
        x = {n: v[~settled_] for n, v in x.items()}
        x["done"] = np.zeros(len(x["doc"]), bool)
        if self.kept is not None:
            x = {n: np.concatenate([self.kept[n], v]) for n, v in x.items()}
        if not len(x["doc"]):
            return away, {n: v[:0] for n, v in x.items()}
        new_trigger = np.concatenate([[True], x["trigger"][1:] != x["trigger"][:-1]])
        new_name = new_trigger | np.concatenate([[True], x["name"][1:] != x["name"][:-1]])
        group, run = np.cumsum(new_trigger) - 1, np.cumsum(new_name) - 1
        several = np.bincount(group[new_name]) > 1
        first = np.flatnonzero(new_name)
        least = x["doc"][first][run]
        open_ = ~x["done"]
        gone = open_ & (x["doc"] > least)
        entry = open_ & (x["doc"] == least) & (several[group] | (x["kind"] == HOT))
        last = group == group[-1]
        if several[-1]:
            stay = np.array([np.flatnonzero(last)[0], first[-1]])
            done = np.ones(2, bool)
        else:
            stay = np.flatnonzero(last & (x["doc"] == least))
            done = x["done"][stay] | entry[stay]
        self.kept = {n: v[stay] for n, v in x.items()} | {"done": done}
        removed = {n: np.concatenate([away[n], x[n][gone]]) for n in self.NAMES}
        return removed, {n: x[n][entry] for n in self.NAMES}


def _sweep(parse: DataFrame) -> DataFrame:
    """``kind, trigger, doc, rep, start, stop``: strings that go (SETTLED), and the dictionary (PHRASE or HOT)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep()
        for batch in batches:
            if batch.num_rows:
                removed, entries = sweep.take(batch)
                kinds = np.concatenate([np.full(len(removed["doc"]), SETTLED), entries["kind"]]).astype(np.int8)
                columns = [np.concatenate([removed[n], entries[n]]) for n in ("trigger", "doc", "rep", "start", "stop")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds), *map(pa.array, columns)], ["kind", "trigger", "doc", "rep", "start", "stop"]
                )

    # a hot trigger's phrases are dealt out one by one
    spread = F.when(F.col("kind") == HOT, F.col("trigger").bitwiseXOR(F.col("name"))).otherwise(F.col("trigger"))
    placed = parse.repartition(spread).sortWithinPartitions("trigger", "name", "doc")
    return placed.mapInArrow(read, "kind tinyint, trigger bigint, doc bigint, rep int, start bigint, stop bigint")


def _with_spans(rows: DataFrame, spans: DataFrame, *fields: str, how: str) -> DataFrame:
    """Texts with their spans as one list each."""
    lists = spans.groupBy("doc", "rep").agg(F.collect_list(F.struct(*fields)).alias("spans"))
    return rows.join(lists, ["doc", "rep"], how)


def _entries(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The dictionary with the bytes of its phrases."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", SLICE_BYTES):
            spans = batch.column("spans")
            sizes = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            trigger, start, stop, kind = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("trigger", "start", "stop", "kind"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            texts = batch.column("body").to_pylist()
            found = [texts[o][a:b] for o, a, b in zip(owner.tolist(), start.tolist(), stop.tolist())]
            ids, reps = (batch.column(n).to_numpy(zero_copy_only=False)[owner] for n in ("doc", "rep"))
            for a in range(0, len(found), 20_000):
                cut = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trigger[cut]), pa.array(ids[cut]), pa.array(reps[cut]), pa.array(start[cut]),
                     pa.array(kind[cut]), pa.array(found[cut], pa.binary())],
                    ["trigger", "doc", "rep", "start", "kind", "bytes"],
                )

    joined = _with_spans(rows, dictionary, "trigger", "start", "stop", "kind", how="inner")
    return joined.select("doc", "rep", "body", "spans").mapInArrow(
        read, "trigger bigint, doc bigint, rep int, start bigint, kind tinyint, bytes binary"
    )


def _suffixes(parts: list[bytes], length: int):
    """All strings of the length in the parts: part, place in it, place in the block, hash; and the block."""
    block = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    counts = np.maximum(0, sizes - length + 1)
    part = np.repeat(np.arange(len(parts)), counts)
    inside = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = inside + np.repeat(np.cumsum(sizes) - sizes, counts)
    return part, inside, at, Hashes(block).of(at, at + length), block


def later_strings(group: np.ndarray, doc: np.ndarray, parts: list[bytes], length: int):
    """Part and place of every string that an earlier document of the same group has too.

    Suffixes are ordered by group, hash and document; a hash is believed only
    after the bytes have been compared.
    """
    part, inside, at, hashed, block = _suffixes(parts, length)
    passes, hits = -(-len(part) // PASS_ROWS), []
    for k in range(passes):
        some = np.flatnonzero(hashed % np.uint64(passes) == k) if passes > 1 else np.arange(len(part))
        some = some[np.lexsort((doc[part[some]], hashed[some], group[part[some]]))]
        if not len(some):
            continue
        h, g = hashed[some], group[part[some]]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        first = some[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        late = doc[part[some]] > doc[part[first]]
        a, b = some[late], first[late]
        same = np.ones(len(a), bool)
        for c in range(length):
            same &= block[at[a] + c] == block[at[b] + c]
        hits.append(a[same])
        if not same.all():  # two strings of one hash: compare such a run by its bytes
            for f in np.unique(b[~same]):
                least: dict[bytes, int] = {}
                for i in some[first == f].tolist():
                    key = block[at[i]:at[i] + length].tobytes()
                    if doc[part[i]] > least.setdefault(key, int(doc[part[i]])):
                        hits.append(np.array([i]))
    found = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
    return part[found], inside[found]


def _compare(entries: DataFrame, length: int) -> DataFrame:
    """Strings of the dictionary that go: ``doc, rep, start, stop``."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        trigger, doc, rep, start, parts = (list(x) for x in zip(*rows))
        ids, starts = np.array(doc, np.int64), np.array(start, np.int64)
        part, inside = later_strings(np.array(trigger, np.int64), ids, parts, length)
        p, a, b = _merged(part, inside, inside + length)
        return pa.RecordBatch.from_arrays([
            pa.array(ids[p]), pa.array(np.array(rep, np.int32)[p]), pa.array(starts[p] + a), pa.array(starts[p] + b)
        ], ["doc", "rep", "start", "stop"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("trigger", "doc", "rep", "start", "bytes"))):
                if row[0] != key and size > GROUP_BYTES:
                    yield flush(held)
                    held, size = [], 0
                key = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    placed = entries.repartition("trigger").sortWithinPartitions("trigger", "doc")
    return placed.select("trigger", "doc", "rep", "start", "bytes").mapInArrow(read, "doc bigint, rep int, start bigint, stop bigint")


def _compare_hot(entries: DataFrame, length: int) -> DataFrame:
    """The same for hot triggers: the least document of every string, found by an aggregate and joined back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("bytes").to_pylist()
            if not parts:
                continue
            part, inside, at, _, block = _suffixes(parts, length)
            for a in range(0, len(part), 50_000):
                cut = slice(a, a + 50_000)
                text = block[at[cut][:, None] + np.arange(length)].tobytes()
                n = len(part[cut])
                yield pa.RecordBatch.from_arrays([
                    pa.array([text[i * length:(i + 1) * length] for i in range(n)], pa.binary()),
                    *(pa.array(batch.column(c).to_numpy(zero_copy_only=False)[part[cut]]) for c in ("doc", "rep")),
                    pa.array(batch.column("start").to_numpy(zero_copy_only=False)[part[cut]] + inside[cut]),
                ], ["string", "doc", "rep", "start"])

    strings = landed(entries.select("doc", "rep", "start", "bytes").mapInArrow(read, "string binary, doc bigint, rep int, start bigint"), "strings")
    least = landed(strings.groupBy("string").agg(F.min("doc").alias("least")), "least")
    late = strings.join(least, "string").filter("doc > least")
    return late.select("doc", "rep", "start", (F.col("start") + length).alias("stop"))


def removed_spans(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, trigger: int = TRIGGER,
    hot_partitions: int | None = None, sample: int = SAMPLE,
) -> tuple[DataFrame, DataFrame]:
    """``doc, rep, start, stop`` of strings that go (they may overlap), and the texts they belong to (``doc, rep, body``)."""
    spark = documents.sparkSession
    rows = _keyed(documents, id_col, text_col)
    partitions = hot_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot_triggers(rows, length, trigger, partitions, sample)
    swept = landed(_sweep(_parse(rows, length, trigger, hot)), "sweep")
    release(spark)
    spans = swept.filter(F.col("kind") == SETTLED).select("doc", "rep", "start", "stop")
    dictionary = swept.filter(F.col("kind") != SETTLED)
    entries = _entries(rows, dictionary)
    if not len(hot):
        more = landed(_compare(entries, length), "compare")
    else:
        entries = landed(entries, "entries")
        cool, warm = entries.filter(F.col("kind") == PHRASE), entries.filter(F.col("kind") == HOT)
        more = landed(_compare(cool, length), "compare").unionByName(landed(_compare_hot(warm, length), "hot"))
    release(spark)
    return spans.unionByName(more), rows


def dedup_substrings(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, trigger: int = TRIGGER,
    hot_partitions: int | None = None, sample: int = SAMPLE,
) -> DataFrame:
    """One row per input row: ``doc_id, kept, spans, n_bytes, n_removed``.

    ``kept`` are the remaining bytes, ``spans`` the removed runs (start, stop).
    NULL and empty texts have no bytes. A NULL id counts as larger than all
    others; rows of one id, repeated ones too, take nothing from each other.
    An empty table gives no rows; other columns are ignored.
    """
    spans, rows = removed_spans(documents, id_col, text_col, length, trigger, hot_partitions, sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", SLICE_BYTES):
            out: tuple[list, ...] = ([], [], [], [])
            lists = batch.column("spans")
            offsets, flat = lists.offsets.to_numpy(), lists.values
            starts, stops = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "stop"))
            for k, body in enumerate(batch.column("body").to_pylist()):
                a, b = (offsets[k], offsets[k + 1]) if lists[k].is_valid else (0, 0)
                _, s, e = _merged(np.zeros(b - a, np.int64), starts[a:b], stops[a:b])
                s, e = s.tolist(), e.tolist()
                out[0].append(b"".join([body[i:j] for i, j in zip([0, *e], [*s, len(body)])]))
                out[1].append([{"start": i, "stop": j} for i, j in zip(s, e)])
                out[2].append(len(body))
                out[3].append(sum(e) - sum(s))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array(out[0], pa.binary()), pa.array(out[1], span), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()),
            ], ["doc", "kept", "spans", "n_bytes", "n_removed"])

    joined = _with_spans(rows, spans, "start", "stop", how="left").select("doc", "body", "spans")
    done = joined.mapInArrow(
        read, "doc bigint, kept binary, spans array<struct<start:bigint,stop:bigint>>, n_bytes bigint, n_removed bigint"
    )
    return done.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "kept", "spans", "n_bytes", "n_removed")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings of earlier ones."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op3_substring_dedup": op3_substring_dedup}

ORACLES = {"op3_substring_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (
  select doc_id, k, substr(h, 1000 * k + 1, 1098) as part
  from (select doc_id, h, unnest(range(0, len(h) // 1000 + 1)) as k from d)
), s as (
  select doc_id, 500 * k + q as p, substr(part, 2 * q + 1, 100) as string
  from (select doc_id, k, part, unnest(range(0, least(500, len(part) // 2 - 49))) as q from c where len(part) >= 100)
), late as (
  select doc_id, p from s join (select string, min(doc_id) as least from s group by string having count(*) > 1) using (string)
  where doc_id > least
), runs as (
  select doc_id, min(p) as a, max(p) + 50 as b from (
    select doc_id, p, sum(case when p - prev <= 50 then 0 else 1 end) over (partition by doc_id order by p) as run
    from (select doc_id, p, lag(p) over (partition by doc_id order by p) as prev from late)
  ) group by doc_id, run
), pieces as (
  select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from runs
), cut as (
  select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, max(b) as tail,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept
  from pieces join d using (doc_id) group by doc_id
)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(concat(coalesce(kept, ''), substr(h, 2 * coalesce(tail, 0) + 1)))) as kept_sha256
from d left join cut using (doc_id)
"""}
