"""Secret scans: fixed patterns, and character Markov models of random strings.

Base spans come from three patterns, leftmost and non-overlapping per kind.
The method adds spans of a fourth kind, ``random``: runs of at least
``MIN_RUN`` token characters that a first-order character Markov model of
random strings explains better than one of ordinary identifiers, by at least
``THRESHOLD`` nats a transition (log-likelihood ratio). Both models are
trained here from labelled samples of the corpus itself: the values of base
spans are the random strings, runs that touch no base span the ordinary
identifiers. Counts are taken over all documents; the model holds at most
(alphabet + 1)^2 transitions per class, so it is broadcast with a fixed bound.

Everything is column functions, windows, joins and aggregates: positions of
all matches come from ``split`` and ``regexp_extract_all`` (the pieces before
each match and the matches themselves), summed in order by a window per
document and kind. No Python runs on the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import landed, table

# Fixed values of the contract: the base patterns, their kinds in order and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
#: Leftmost runs of 16+ after the prefix are exactly the matches of ``AKIA[A-Z0-9]+`` of 20+ characters.
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: Leftmost runs of 24+ are exactly the maximal matches of ``[0-9a-f]+`` of 24+ characters.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs scored by the models, their least length, and the ratio that makes them a span.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
MIN_RUN = 16
THRESHOLD = 1.0
SPAN = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"
#: Symbols a transition can lead to: the 66 run characters and the end.
VOCAB = 67


def _located(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Array of (kind, place, piece length, match, value): every match with the text before it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), group)
    pieces = F.split(text, pattern, -1)
    return F.transform(matches, lambda m, j: F.struct(
        F.lit(kind).alias("kind"), j.alias("pos"), F.char_length(F.get(pieces, j)).alias("plen"),
        F.char_length(m).alias("mlen"), F.get(values, j).alias("value"),
    ))


def found(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``row, doc_id, base`` (spans sorted) and ``runs`` (runs touching no base span)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.concat(
        _located(text, ASSIGN, "assign", 2), _located(text, ACCESS, "access"),
        _located(text, HEX, "hex"), _located(text, RUN, "run"),
    )
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), spans.alias("spans")
    ).select("row", "doc_id", F.explode_outer("spans").alias("s")).select("row", "doc_id", "s.*")
    walk = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("start", F.sum(F.col("plen") + F.col("mlen")).over(walk) - F.col("mlen")).select(
        "row", "doc_id", "kind", "start", (F.col("start") + F.col("mlen")).alias("end"), "value",
    ).filter(F.col("kind").isNull() | (F.col("kind") != "assign") | (F.char_length("value") >= ASSIGN_VALUE))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("ord"), "kind", "end", "value")
    grouped = placed.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin(*KINDS), span))).alias("base"),
        F.collect_list(F.when(F.col("kind") == "run", span)).alias("runs"),
    )
    apart = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return landed(grouped.select("row", "doc_id", "base", apart.alias("runs")), "secrets")


def transitions(strings: DataFrame) -> DataFrame:
    """``(..., prev, next)`` per character transition of ``value``, from ``^`` and to ``$``; linear in its length."""
    chars = F.split("value", "", -1)
    pairs = F.arrays_zip(F.concat(F.array(F.lit("^")), chars).alias("prev"), F.concat(chars, F.array(F.lit("$"))).alias("next"))
    return strings.select("*", F.explode(pairs).alias("t")).select("*", "t.prev", "t.next").drop("t")


def model(per_doc: DataFrame) -> DataFrame:
    """``prev, next, llr``: log P(random) - log P(identifier), add-one smoothed; and ``prev, default`` for unseen pairs."""
    samples = per_doc.select(F.explode("base.value").alias("value"), F.lit(1).alias("label")).unionByName(
        per_doc.select(F.explode("runs.value").alias("value"), F.lit(0).alias("label")))
    counts = transitions(samples).groupBy("prev", "next").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("c1"), F.count(F.when(F.col("label") == 0, 1)).alias("c0"))
    totals = Window.partitionBy("prev")
    t1, t0 = F.sum("c1").over(totals) + VOCAB, F.sum("c0").over(totals) + VOCAB
    return counts.select(
        "prev", "next", (F.log((F.col("c1") + 1) / t1) - F.log((F.col("c0") + 1) / t0)).alias("llr"),
        (F.log(1 / t1) - F.log(1 / t0)).alias("default"),
    )


def secret_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, sorted by
    start and then by kind (assign, access, hex, random), comma-joined.
    ``base_sha256`` is the lowercase hex SHA-256 of the base spans so joined
    (of an empty string when there are none); ``spans`` adds the method's
    ``random`` spans, which never overlap a base span. A NULL text counts as
    empty; NULL ids are kept; repeated rows give one row each; very long
    texts are scanned whole; an empty table gives no rows (the model is then
    empty and scores nothing). Other columns are ignored.
    """
    per_doc = found(documents, id_col, text_col)
    scores = F.broadcast(model(per_doc))
    runs = per_doc.select("row", F.explode("runs").alias("r")).select("row", "r.start", "r.end", "r.value")
    steps = transitions(runs)
    defaults = scores.select("prev", "default").distinct()
    scored = steps.join(scores.select("prev", "next", "llr"), ["prev", "next"], "left").join(
        F.broadcast(defaults), "prev", "left").groupBy("row", "start", "end").agg(
        F.avg(F.coalesce("llr", "default", F.lit(0.0))).alias("llr"))
    random = scored.filter(F.col("llr") >= THRESHOLD).groupBy("row").agg(F.collect_list(F.struct(
        F.col("start").cast("long").alias("start"), F.lit(len(KINDS)).cast("int").alias("ord"),
        F.lit("random").alias("kind"), F.col("end").cast("long").alias("end"))).cast(SPAN).alias("extra"))
    joined = per_doc.join(random, "row", "left")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", lambda s: F.struct(
        s["start"].cast("long").alias("start"), s["ord"].cast("int").alias("ord"), s["kind"].alias("kind"),
        s["end"].cast("long").alias("end")))
    every = F.array_sort(F.concat(base, F.coalesce("extra", F.array().cast(SPAN))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(every, text)).alias("spans"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op12_secret_scan": op12_secret_scan}
ORACLES = {"op12_secret_scan": r"""
with docs as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents),
pats(kind, ord, pat, grp) as (values
  ('assign', 1, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
  ('access', 2, 'AKIA[A-Z0-9]{16,}', 0), ('hex', 3, '[0-9a-f]{24,}', 0), ('run', 0, '[A-Za-z0-9+/_=-]{16,}', 0)),
found as (
  select rid, doc_id, kind, ord, regexp_extract_all(t, pat, 0) as ms, regexp_extract_all(t, pat, grp) as vs,
    regexp_split_to_array(t, pat) as ps
  from docs, pats),
placed as (
  select rid, doc_id, kind, ord, j, length(ps[j]) as plen, length(ms[j]) as mlen, vs[j] as value
  from (select *, unnest(generate_series(1, len(ms))) as j from found)),
spans as (
  select rid, doc_id, kind, ord, sum(plen + mlen) over (partition by rid, kind order by j) - mlen as s, mlen, value
  from placed),
kept as (select rid, doc_id, kind, ord, s, s + mlen as e, value from spans where kind <> 'assign' or length(value) >= 6),
base as (select * from kept where kind <> 'run'),
runs as (
  select r.* from kept r where r.kind = 'run'
  and not exists (select 1 from base b where b.rid = r.rid and b.s < r.e and r.s < b.e)),
samples as (select value, 1 as label from base union all select value, 0 as label from runs),
chars as (select label, ['^'] || string_split(value, '') || ['$'] as cs from samples),
trans as (select label, cs[i] as prev, cs[i + 1] as nxt from (select *, unnest(generate_series(1, len(cs) - 1)) as i from chars)),
counts as (
  select prev, nxt, count(*) filter (where label = 1) as c1, count(*) filter (where label = 0) as c0
  from trans group by prev, nxt),
model as (
  select prev, nxt,
    ln((c1 + 1) / (sum(c1) over (partition by prev) + 67)) - ln((c0 + 1) / (sum(c0) over (partition by prev) + 67)) as llr,
    ln(1 / (sum(c1) over (partition by prev) + 67)) - ln(1 / (sum(c0) over (partition by prev) + 67)) as dflt
  from counts),
defaults as (select distinct prev, dflt from model),
run_chars as (select rid, s, e, ['^'] || string_split(value, '') || ['$'] as cs from runs),
run_trans as (select rid, s, e, cs[i] as prev, cs[i + 1] as nxt from (select *, unnest(generate_series(1, len(cs) - 1)) as i from run_chars)),
scored as (
  select t.rid, t.s, t.e, avg(coalesce(m.llr, d.dflt, 0.0)) as llr
  from run_trans t left join model m on m.prev = t.prev and m.nxt = t.nxt left join defaults d on d.prev = t.prev
  group by t.rid, t.s, t.e),
every as (
  select rid, kind, ord, s, e from base
  union all select rid, 'random', 4, s, e from scored where llr >= 1.0),
joined as (
  select rid,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (where kind <> 'random') as base_text,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) as all_text,
    count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
    count(*) filter (where kind = 'hex') as n_hex
  from every group by rid)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base_text, '')) as base_sha256, coalesce(all_text, '') as spans
from docs d left join joined j using (rid)
"""}
