import uuid

import pytest

from leafstack.schemas import CHUNKS, EVAL_QUESTIONS, PARTS
from leafstack.session import few_listing_tasks
from leafstack.sources import ensure_chunks, ensure_parts, ensure_schema, from_rows, qualified
from leafstack.streaming import (
    bucket_of, committed_version, expire_versions, ingest_numbered_chunks, ingest_raw, load_all, read_version, upsert_stream,
    write_version,
)


def name(label):
    return f"{label}_{uuid.uuid4().hex[:8]}"


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for stem, text in files.items():
        (folder / f"{stem}.txt").write_text(text)


def test_two_stage_load_takes_new_files_only(spark, tmp_path):
    files, root = tmp_path / "in", str(tmp_path / "out")
    raw, chunks = name("raw"), name("chunks")
    put(files, a="# one\ntext\n# two\fpage two", b="only")
    (files / "c.bin").write_text("not matched")
    for expected in (4, 4):
        paths = load_all(spark, str(files), raw, chunks, root, "*.txt")
        assert spark.table(chunks).count() == expected
    assert paths.count() == 2
    put(files, d="late\f\f")
    paths = load_all(spark, str(files), raw, chunks, root, "*.txt")
    assert spark.table(chunks).count() == 5 and paths.count() == 3
    rows = spark.table(chunks)
    assert rows.schema.fieldNames() == CHUNKS.fieldNames()
    assert rows.select("id").distinct().count() == 5
    page = rows.filter("content = 'page two'").head()
    assert (page["title"], page["page_number"]) == ("a", 1)


def test_failing_documents_do_not_stop_the_load(spark, tmp_path):
    files, root = tmp_path / "in", str(tmp_path / "out")
    put(files, good="fine", bad="broken")
    (files / "junk.txt").write_bytes(b"\xff\xfe\x00")

    def parser(content):
        text = bytes(content).decode()
        if text == "broken":
            raise ValueError(text)
        return [("T", 0, text)]

    raw, chunks = name("raw"), name("chunks")
    load_all(spark, str(files), raw, chunks, root, "*.txt", parser=parser)
    assert [r["content"] for r in spark.table(chunks).collect()] == ["fine"]
    assert spark.table(raw).count() == 3
    plain_raw, plain = name("raw"), name("chunks")
    load_all(spark, str(files), plain_raw, plain, str(tmp_path / "plain"), "*.txt")
    assert sorted(r["content"] for r in spark.table(plain).collect()) == ["broken", "fine"]


def test_numbered_ids_go_on_and_survive_a_retry(spark, tmp_path):
    files, out = tmp_path / "in", str(tmp_path / "chunks")
    raw = name("raw")

    def run():
        ingest_raw(spark, str(files), raw, str(tmp_path / "p_raw"), "*.txt", str(tmp_path / "raw"))
        ingest_numbered_chunks(spark, raw, out, str(tmp_path / "p_chunks"))

    def ids():
        return sorted((r["id"], r["content"]) for r in spark.read.parquet(out).collect())

    put(files, a="x\fy", b="z")
    run()
    assert ids() == [(1, "x"), (2, "y"), (3, "z")]
    put(files, c="w")
    run()
    assert ids() == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    # A batch that ran but was not marked as done runs again and replaces its directory.
    last = max((tmp_path / "p_chunks" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert ids() == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    ingest_numbered_chunks(spark, raw, out, str(tmp_path / "p_again"))
    assert [i for i, _ in ids()] == list(range(1, 9))


def page(n, items):
    rows = "".join(f'<li><a href="/p{i}">{d}</a></li>' for i, d in enumerate(items))
    return (n, f"http://h/{n}", f"<title>T{n}</title><h1>H{n}</h1><ul>{rows}</ul>")


SCHEMA = "page_id bigint, url string, html string"


def test_streaming_upsert(spark, tmp_path):
    folder, root = str(tmp_path / "pages"), str(tmp_path / "parts")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        upsert_stream(stream, root, str(tmp_path / "progress"))
        return sorted(
            (r["qr_code_url"], r["item_number"], r["designation"])
            for r in read_version(spark, root, PARTS).collect()
        )

    spark.createDataFrame([page(1, ["a", "b"]), page(2, ["c"])], SCHEMA).write.parquet(folder)
    first = [("http://h/1", 1, "a"), ("http://h/1", 2, "b"), ("http://h/2", 1, "c")]
    assert run() == first
    assert run() == first
    spark.createDataFrame([page(1, ["A"]), page(4, ["d"])], SCHEMA).write.mode("append").parquet(folder)
    second = [("http://h/1", 1, "A"), ("http://h/1", 2, "b"), ("http://h/2", 1, "c"), ("http://h/4", 1, "d")]
    assert run() == second
    version = committed_version(spark, root)
    last = max((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == second and committed_version(spark, root) == version
    # Only the buckets of pages 1 and 4 were written again.
    pages = spark.createDataFrame([("http://h/1",), ("http://h/2",), ("http://h/4",)], "u string")
    one, two, three = (r["b"] for r in pages.select(bucket_of("u").alias("b")).collect())
    written = {p.name for p in (tmp_path / "parts" / "buckets=64" / "version=1").glob("*/*/bucket=*")}
    assert two not in (one, three), (one, two, three)
    assert written == {f"bucket={one}", f"bucket={three}"}
    assert expire_versions(spark, root, 1) == 1 and run() == second
    # A stream that starts over is not taken for a repeated one.
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    spark.createDataFrame([page(5, ["e"])], SCHEMA).write.mode("append").parquet(folder)
    upsert_stream(stream.filter("page_id = 5"), root, str(tmp_path / "progress2"))
    assert ("http://h/5", 1, "e") in run() and len(run()) == len(second) + 1
    with pytest.raises(ValueError, match="has 64 buckets"):
        write_version(read_version(spark, root, PARTS), root, 9, "qr_code_url", 32)


def test_unfinished_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "n", "d", "c", "m", "u")], PARTS)
    write_version(rows, root, 0, "qr_code_url")
    base = tmp_path / "t" / "buckets=64"
    bucket = next((base / "version=0").glob("*/*/bucket=*")).name
    cut = base / "version=1" / "stream=5" / "batch=0" / bucket
    cut.mkdir(parents=True)
    (cut / "part-0.parquet").write_text("cut off")
    assert committed_version(spark, root) == 0
    assert read_version(spark, root, PARTS).count() == 1
    assert read_version(spark, str(tmp_path / "none"), PARTS).count() == 0


def test_catalog_objects(spark):
    schema = name("s_x")
    try:
        assert ensure_schema(spark, f"`{schema}`") == schema
        ensure_schema(spark, schema)
        assert spark.catalog.currentDatabase() == schema
        assert ensure_chunks(spark, "chunks").schema.fieldNames() == CHUNKS.fieldNames()
        assert [f.dataType for f in ensure_parts(spark, f"{schema}.parts").schema] == [f.dataType for f in PARTS]
        ensure_parts(spark, f"{schema}.parts")
        assert qualified("a-b.c") == "`a-b`.`c`"
    finally:
        spark.catalog.setCurrentDatabase("default")


def test_from_rows(spark):
    import pandas as pd

    rows = [("q1", "s1"), ("q2", "s2")]
    a = from_rows(spark, rows, EVAL_QUESTIONS)
    b = from_rows(spark, pd.DataFrame(rows, columns=["question", "source"]), EVAL_QUESTIONS)
    assert a.schema == b.schema == EVAL_QUESTIONS and a.exceptAll(b).count() == 0


def test_many_small_files_are_one_batch(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(1200):
        (folder / f"d{i % 40}").mkdir(parents=True, exist_ok=True)
        (folder / f"d{i % 40}" / f"{i}.txt").write_text(str(i))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, raw = spark.conf.get(key), name("raw")
    ingest_raw(spark, str(folder), raw, str(tmp_path / "progress"), "*.txt", str(tmp_path / "raw"))
    assert spark.table(raw).select("path").distinct().count() == spark.table(raw).count() == 1200
    assert [p.name for p in (tmp_path / "progress" / "commits").glob("[0-9]*")] == ["0"]
    assert spark.conf.get(key) == before
    with few_listing_tasks(spark):
        assert int(spark.conf.get(key)) <= 4 * spark.sparkContext.defaultParallelism
