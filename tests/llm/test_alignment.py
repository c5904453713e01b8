import hashlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from leafstack.llm import alignment

from .conftest import COLUMNS, SF


def _pieces(ids, table):
    return [table[i] for i in ids]


def brute(rows):
    """Per document by plain loops: every A-B pair tested for overlap, groups cut by walking both sides."""
    tok_a, (table_a, *_) = alignment.tokenizer_a(public_tokenizers.path(alignment.A_FILE))
    sp, (table_b, *_) = alignment.tokenizer_b(public_tokenizers.path(alignment.B_FILE))
    per = []
    for doc_id, text in rows:
        if not text:
            per.append((doc_id, None))
            continue
        a = tok_a.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        target = (" " + text).encode()
        pa_, pb = _pieces(a, table_a), _pieces(b, table_b)
        if b"".join(pa_) != target or b"".join(pb) != target:
            per.append((doc_id, None))
            continue
        ra, pos = [], 0
        for p in pa_:
            ra.append((pos, pos + len(p)))
            pos += len(p)
        rb, pos = [], 0
        for p in pb:
            rb.append((pos, pos + len(p)))
            pos += len(p)
        links = [(i, j) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]
        groups, cur_a, cur_b, i, j = [], [], [], 0, 0
        while i < len(ra) or j < len(rb):
            if j >= len(rb) or (i < len(ra) and ra[i][1] <= rb[j][1]):
                cur_a.append(a[i]); i += 1
            else:
                cur_b.append(b[j]); j += 1
            ea = ra[i - 1][1] if i else -1
            eb = rb[j - 1][1] if j else -2
            if ea == eb and cur_a and cur_b:
                groups.append(",".join(map(str, cur_a)) + "|" + ",".join(map(str, cur_b)))
                cur_a, cur_b = [], []
        per.append((doc_id, (a, b, links, groups)))
    counts = Counter()
    for _, r in per:
        if r:
            counts.update({(r[0][i], r[1][j]) for i, j in r[2]})
    best = Counter()
    for (x, _), c in counts.items():
        best[x] = max(best[x], c)
    out = []
    for doc_id, r in per:
        if not r:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = r
        pairs = [(a[i], b[j]) for i, j in links]
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_against_brute_force_on_short_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 3000")
    got = _rows(alignment.alignments(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[1] > 0 for r in got) > len(got) // 2


def test_special_strings_null_and_repeats(spark):
    rows = [(1, "Hello <|endoftext|> world <s> </s> x"), (2, None), (3, ""), (4, "Hello world"), (4, "Hello world"),
            (5, "naïve café 😀 — ok"), (6, "two  spaces"), (7, "\ttab start")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS).withColumn("row", F.lit("x"))
    got = _rows(alignment.alignments(df))
    assert got == brute(rows)
    assert [r for r in got if r[0] == 1][0][1] > 5


def test_empty_table(spark, nothing):
    assert alignment.alignments(nothing).count() == 0


def test_odd_rows(spark, odd):
    got = alignment.alignments(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_a == 0) == (r.groups_sha256 == "")
    empty = [r for r in got if r.doc_id in (2, 3)]
    assert empty and all(r.n_a == r.n_b == r.n_links == r.count_sum == 0 for r in empty)
    assert max(r.n_a for r in got) > 100_000


def test_texts_of_a_batch_do_not_meet():
    texts = ["ab", None, "b", "", "Hello world", "x\u0000y", "naïve café", "Hello world"]
    paths = [public_tokenizers.path(f) for f in (alignment.A_FILE, alignment.B_FILE, alignment.A_RANKS)]
    rows, pairs = alignment.align_batch(texts, *paths)
    alone = [alignment.align_batch([t], *paths) for t in texts]
    assert rows == [r[0] for r, _ in alone]
    assert pairs[["id_a", "id_b", "n"]].to_numpy().tolist() == [
        p for _, one in alone for p in one[["id_a", "id_b", "n"]].to_numpy().tolist()]


def test_links_are_not_sorted_to_meet_their_counts(spark):
    plan = alignment.alignments(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "ShuffledHashJoin [pair" in physical and "SortMergeJoin [pair" not in physical
