import gzip
import hashlib

import duckdb

from vacantia.llm import warc as W
from vacantia.session import new_work_dir

BIG, OTHER = "x" * 1000, "é" * 500


def pages(spark):
    rows = [
        (1, "http://a", BIG), (5, None, BIG), (3, "http://c", BIG), (2, "u", "x" * 999), (9, "u", "x" * 999),
        (4, "u", OTHER), (4, "u", OTHER), (7, "v", None), (8, "v", ""), (6, "w", OTHER + "\r\n\r\nWARC/1.1\r\n"),
        (10, "two\r\nlines", BIG[:-1] + "y"), (None, "n", BIG),
    ]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string"), rows


def brute(rows):
    groups = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 1000:
            groups.setdefault(html, []).append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        original = max((p for p in groups.get(html, []) if p is not None), default=None)
        revisit = html in groups and page_id != original
        out.append(
            (page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
             original if revisit else None)
        )
    return sorted(out, key=repr)


def test_round_trip(spark, monkeypatch):
    frame, rows = pages(spark)
    catalogue = W.write_archives(spark, frame, new_work_dir(spark, "w"))
    records = W.read_archives(spark, catalogue)
    got = W.resolved(records).collect()
    assert sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr
    ) == brute(rows)
    html = {(p, h or "") for p, _, h in rows}
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload).decode()) in html
    assert {r.url for r in got} >= {"http://a", "urn:page:5", "twolines"}
    files = [r.path.removeprefix("file://") for r in catalogue.collect()]
    text = b"".join(gzip.open(f).read() for f in files)
    assert text.count(b"WARC-Type: revisit") == 3 and text.count(BIG.encode() + b"\r\n") == 1


def test_files_are_cut(spark):
    frame, rows = pages(spark)
    original = W.FILE_BYTES
    archive = None
    try:
        W.FILE_BYTES = 200
        folder = f"file://{new_work_dir(spark, 'w').removeprefix('file://')}"
        base, path = W.fs.FileSystem.from_uri(folder)
        base.create_dir(path, recursive=True)
        archive = W._Archive(folder)
        for page_id, url, html in rows:
            archive.add(W.record(page_id, url, (html or "").encode(), None))
        archive.close()
    finally:
        W.FILE_BYTES = original
    assert len(archive.done) > 3 and sum(n for _, _, n in archive.done) == len(rows)


def test_empty_table_and_sql(spark):
    frame, _ = pages(spark)
    catalogue = W.write_archives(spark, frame.limit(0), new_work_dir(spark, "w"))
    assert W.resolved(W.read_archives(spark, catalogue)).count() == 0
    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    df = W.op6_warc(spark, small)
    cursor = con.execute(W.OP6_SQL)
    assert [c[0] for c in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
