import base64
import hashlib

import pytest

from linecue.llm import warc
from linecue.llm.common import checkpointed, shared_path
from tests.llm.oracle import same_as_duckdb


def want(rows):
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(page, best.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = best[html or ""] != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best[html or ""] if revisit else None, None))
    return sorted(out)


ROWS = [(1, "http://a/", "x"), (2, "u", ""), (3, None, None), (4, "http://b/\r\nWARC-Type: x", "<p>é🙂</p>" * 4000), (5, "http://c", "x"), (6, "", "WARC/1.1\r\n\r\n0\r\n\r\n"), (9, "http://d", "<p>é🙂</p>" * 4000), (10, "http://e", "y" * 70_000), (11, "z", "\r\n")]


@pytest.mark.parametrize("sizes", [{}, {"segment_bytes": 100, "chunk_bytes": 7}, {"segment_bytes": 1 << 20}])
def test_pages_come_back(spark, sizes):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, sha int").repartition(3)
    assert sorted(map(tuple, warc.archived_pages(pages, **sizes).collect())) == want(ROWS)


def test_equal_rows_null_ids_and_empty_table(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "v", "a"), (None, "w", "a"), (None, None, None)]
    got = warc.archived_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got if r.payload_bytes) == [(0, 1, "revisit", 1), (1, 1, "response", None), (1, 1, "revisit", 1), (1, 1, "revisit", 1)]
    assert [(r.page_id, r.record_type) for r in got if not r.payload_bytes] == [(None, "response")]
    assert warc.archived_pages(spark.createDataFrame([], schema)).count() == 0


def test_payload_texts(spark):
    path = shared_path(spark, "test")
    warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path, segment_bytes=64, chunk_bytes=10)
    found = warc.payloads(warc.reassemble(warc.read_records(spark, path))).where("type = 'response'").collect()
    stored = {r[0]: (r[2] or "").encode() for r in ROWS if r[0] in (3, 5, 6, 9, 10, 11)}
    assert {int(r.record_id.split(":")[2].split("-")[0]): bytes(r.payload) for r in found} == stored


def test_broken_segments_have_errors(spark):
    path = shared_path(spark, "test")
    warc.write(spark.createDataFrame([(1, "u", "a" * 500)], "page_id long, url string, html string"), path, segment_bytes=64)
    records = checkpointed(warc.read_records(spark, path))
    n = records.count()
    error = lambda df: [r.error for r in warc.payloads(warc.reassemble(df)).collect()]
    assert n > 3 and error(records) == [None]
    assert error(records.where("segment <> 2")) == ["a segment is missing or twice there"]
    assert error(records.where(f"segment <> {n}")) == ["the last segment is missing"]
    assert error(records.union(records.where("segment = 2"))) == ["a segment is missing or twice there"]
    assert error(records.withColumn("total", records.total + 1)) == ["the total length differs"]
    assert error(records.where("segment = 1").withColumn("segment", warc.F.lit(None).cast("int")))[0].startswith("broken block")


def test_framing():
    assert warc.unchunked(b"3;x=y\r\nabc\r\n1\r\nd\r\n0\r\nTrailer: t\r\n\r\n") == b"abcd"
    for wrong in (b"3\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(wrong)


def test_query_equals_sql(spark):
    same_as_duckdb(warc.op8_warc, warc.ORACLE, spark, "/root/testdata/sf0.01")
