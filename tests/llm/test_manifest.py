import hashlib
import zlib

from pyspark.sql import functions as F

from leafstack.llm import manifest

from .conftest import COLUMNS, SF

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes):
    """Root and per-node (left, right) sibling strings, by plain loops."""
    paths, members, level = [[] for _ in nodes], [[k] for k in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, grouped = [], []
        for s in range(0, len(level), 8):
            run = level[s:s + 8]
            for j, m in enumerate(members[s:s + 8]):
                for k in m:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(_h("".join(run)))
            grouped.append([k for m in members[s:s + 8] for k in m])
        level, members = up, grouped
    return level[0], paths


def brute(rows):
    def leaf(r, text):
        return _h("".join(_field(v) for v in (r[0], r[3], r[2], r[4], text)))

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    out, subroots, inner = [], [], {}
    for g in langs:
        items = sorted(((r, leaf(r, r[1])) for r in by_lang[g]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        sub, paths = _tree([x[1] for x in items])
        subroots.append(sub)
        inner[g] = (sub, items, paths)
    root, top = _tree(subroots)
    for gi, g in enumerate(langs):
        sub, items, paths = inner[g]
        for (r, lf), p in zip(items, paths):
            path = p + top[gi]
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(LOWERED)
            acc = leaf(r, text)
            for left, right in path:
                acc = _h(left + acc + right)
            out.append((r[0], lf, sub, root, _h("".join(a + b for a, b in path)), acc, acc == root))
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = _rows(manifest.manifest(docs))
    assert got == brute(rows)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_groups_of_every_size(spark):
    # one lone leaf, a group of exactly 8, 9 and 65 (three levels), NULL lang, repeated rows
    rows = [(1, "A", "xx", "s", 1)] + [(10 + i, f"T{i}", "de", None, i) for i in range(8)]
    rows += [(100 + i, "Same", "en", "s", 4) for i in range(9)] + [(200 + i, None, None, "s", None) for i in range(65)]
    rows += [(100, "Same", "en", "s", 4), (None, "Z", "en", None, 1)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert _rows(manifest.manifest(df)) == brute(rows)


def test_odd_rows_and_empty(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert _rows(manifest.manifest(odd)) == brute(rows)
    assert manifest.manifest(nothing).count() == 0
    one = spark.createDataFrame([(5, "Only", "en", "a", 4)], COLUMNS)
    (r,) = manifest.manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == _h("")
