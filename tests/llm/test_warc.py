import gzip
from hashlib import sha1

import duckdb
import pytest
from pyspark.sql import functions as F

from segstats.llm import queries, warc

SF = "/root/testdata/sf0.001"

LONG = "<p>é</p>" * 300


def make(spark):
    rows = [
        (1, "http://a/1", LONG), (7, "http://a/7", LONG), (3, None, LONG), (4, "http://a/4 x\r\ny", "short"), (5, "http://b", "short"),
        (6, "http://c", None), (8, "http://c", ""), (None, "http://d", LONG), (9, "http://e", "z" * 3_000_000 + "\r\n\r\n"),
        (7, "http://a/7", LONG), (10, "http://f", "\r\n\r\nWARC/1.1\r\n\r\n" * 3),
    ] + [(k, "http://hot", "same " * 400) for k in range(100, 140)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("length", F.lit(1))


def brute(rows, least=1000):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if page is not None and len(body) >= least:
            first[body] = max(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        original = first.get(body) if len(body) >= least else None
        revisit = original is not None and original != page
        out.append((page, len(body), sha1(body).hexdigest(), "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path, monkeypatch):
    rows, pages = make(spark)
    folder = f"file://{tmp_path}/archives"
    index = warc.write_archives(pages, folder)
    found = warc.read_records(index, folder)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()]
    assert sorted(got, key=repr) == brute(rows)
    bodies = {r.page_id: bytes(r.payload) for r in found.filter("record_type = 'response'").collect()}
    assert bodies[9] == rows[8][2].encode() and bodies[10] == rows[10][2].encode() and bodies[6] == b""
    assert {r.page_id: r.url for r in found.collect()}[4] == "http://a/4%20x%0D%0Ay"
    # a selection of the index reads those records only; the index agrees with what is read
    some = index.filter("page_id % 2 = 0")
    assert sorted(r.page_id for r in warc.read_records(some, folder, False).collect()) == sorted(r.page_id for r in some.collect())
    told = index.select("page_id", "payload_bytes", F.col("digest"), "record_type", "refers_to")
    assert sorted(map(tuple, told.collect()), key=repr) == brute(rows)
    assert warc.write_archives(pages.limit(0), folder).count() == 0


def test_archives_are_plain_gzip_members(spark, tmp_path):
    _, pages = make(spark)
    index = warc.write_archives(pages, f"file://{tmp_path}/a").orderBy("archive", "offset").collect()
    for name in {r.archive for r in index}:
        own = [r for r in index if r.archive == name]
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:]))
        with gzip.open(name) as f:
            assert f.read().count(b"WARC-Record-ID: ") == len(own)


def test_damage_is_found(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    index = warc.write_archives(make(spark)[1].coalesce(1), folder)
    bad = index.withColumn("offset", F.col("offset") + 1)
    with pytest.raises(Exception):
        warc.read_records(bad, folder).collect()


def test_ranges_are_coalesced():
    asked = []

    class Source:
        def read_at(self, n, at):
            asked.append((at, n))
            return b"".join(warc._gzip(b"x" * 10) for _ in range(9))[at % 1000:at % 1000 + n] if at < 1000 else warc._gzip(b"y")

        def close(self):
            pass

    class Store:
        def open_input_file(self, name):
            return Source()

    size = len(warc._gzip(b"x" * 10))
    rows = [("f", k * size, size) for k in range(9)] + [("f", 10_000_000, len(warc._gzip(b"y")))]
    assert list(warc.read_ranges(Store(), rows)) == [b"x" * 10] * 9 + [b"y"]
    assert len(asked) == 2


def test_registered_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    df = queries.QUERIES["op1_warc"](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.SQL["op1_warc"])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected and expected
