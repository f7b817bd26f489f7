import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from meterflow.llm import warc

PAGES = "page_id long, url string, html string"
HTML = '<!DOCTYPE html><html lang="en"><head><title>A &amp;\n b</title><script>var t="</p>";</script></head><body><!-- x <p> --><p>One<br>two &lt;3 &amp;amp;</p><div>  three  </div><a href="/q">four</a></body></html>'


def test_records_link_to_their_response(spark):
    (meta, conv) = warc.derive(warc.responses_of(spark.createDataFrame([(7, "http://a/b", HTML)], PAGES))).orderBy(F.desc("warc_type")).collect()
    response = warc.responses_of(spark.createDataFrame([(7, "http://a/b", HTML)], PAGES)).first()
    assert (meta.warc_type, conv.warc_type) == ("metadata", "conversion")
    assert meta.refers_to == conv.refers_to == response.record_id
    assert conv.concurrent_to == meta.record_id and meta.concurrent_to is None
    assert conv.block == "One\ntwo <3 &amp;\nthree\nfour"
    sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    for r in (meta, conv):
        assert r.block_digest == sha(r.block) and r.content_length == len(r.block.encode())
        assert r.source_payload_digest == sha(HTML) and r.source_headers == response.http_headers
    whole = f"{response.status_line}\r\n{response.http_headers}\r\n{HTML}"
    assert f"source-block-digest: {sha(whole)}\r\n" in meta.block
    assert response.http_headers in meta.block
    assert "title: A &amp; b\r\n" in meta.block and "language: en\r\n" in meta.block and "links: 1\r\n" in meta.block


def test_other_media_have_metadata_only(spark):
    rows = [(1, "r1", "u", "d", "HTTP/1.1 200 OK", "Content-Type: image/png\r\n", "x"), (2, "r2", "u", "d", "HTTP/1.1 200 OK", "content-type: text/plain\r\n", " a <b> "), (3, None, None, None, None, None, None)]
    found = warc.derive(spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, warc_date string, status_line string, http_headers string, payload string")).collect()
    assert sorted((r.page_id, r.warc_type) for r in found) == [(1, "metadata"), (2, "conversion"), (2, "metadata"), (3, "metadata")]
    assert [r.block for r in found if r.warc_type == "conversion"] == [" a <b> "]


def test_odd_pages_equal_the_sql(spark, tmp_path):
    html = [None, "", " ", "<p", "<script>", "plain", "é" * 50_000, "<p>" * 20_000, "<!-- " * 5_000, "a\r\nb\x00c", HTML, HTML, "<title>x</title>" * 3, "<HTML LANG=de><A\nHREF='x'>y</A>"]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(None, None, HTML), (3, "http://h/3", "<p")]
    table = spark.createDataFrame(rows, PAGES).withColumn("record_id", F.lit(1)).withColumn("block", F.lit("z"))
    got = warc.derive(warc.responses_of(table))
    con = duckdb.connect()
    pages = table.toArrow()
    con.register("pages", pages)
    want = con.sql(warc.oracle())
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, want.select(*order).fetchall()))


def test_empty_table(spark):
    assert warc.derive(warc.responses_of(spark.createDataFrame([], PAGES))).count() == 0


@pytest.mark.parametrize("compressed", [False, True])
def test_files_round_trip(spark, tmp_path, compressed):
    responses = warc.responses_of(spark.createDataFrame([(1, "http://a", HTML), (2, "http://b", "plain é")], PAGES)).collect()
    parts = []
    for r in responses:
        http = f"{r.status_line}\r\n{r.http_headers}\r\n{r.payload}".encode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {r.record_id}\r\nWARC-Target-URI: {r.target_uri}\r\nWARC-Date: {r.warc_date}\r\nContent-Length: {len(http)}\r\n\r\n"
        parts.append(head.encode() + http + b"\r\n\r\n")
    data = b"".join(gzip.compress(p) for p in parts) if compressed else b"".join(parts)
    (tmp_path / "x.warc").write_bytes(data + (b"" if compressed else b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut off"))
    read = warc.read_responses(spark, str(tmp_path / "x.warc"))
    assert sorted((r.record_id, r.target_uri, r.status_line, r.http_headers, bytes(r.payload).decode()) for r in read.collect()) == sorted((r.record_id, r.target_uri, r.status_line, r.http_headers, r.payload) for r in responses)
    records = warc.derive(read, id_col="position")
    out = warc.write_files(records.drop("position", "content_length", "source_headers", "stated_block_digest", "stated_payload_digest"), str(tmp_path / "out"))
    back = [rec for row in out.collect() for rec in warc.records_of(bytes(row.content))]
    assert sorted((h["warc-type"], h["warc-refers-to"], b.decode()) for h, b in back) == sorted((r.warc_type, r.refers_to, r.block) for r in records.collect())


def record(number, body, headers="Content-Type: text/html; charset=utf-8\r\n", stated=""):
    http = b"HTTP/1.1 200 OK\r\n" + headers.encode() + b"\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{number}>\r\n{stated}Content-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def test_many_members_take_linear_time():
    import time

    body = b"<p>" + b"word " * 400 + b"</p>"
    data = b"".join(gzip.compress(record(i, body + str(i).encode()), 1) for i in range(20_000))
    start = time.time()
    blocks = [b for _, b in warc.records_of(data)]
    assert time.time() - start < 20
    assert len(blocks) == 20_000 and all(b.endswith(str(i).encode()) for i, b in enumerate(blocks))
    assert sum(1 for _ in warc.records_of(data[:-40])) == 19_999


def test_bodies_stay_bytes_and_stated_digests_are_carried(spark, tmp_path):
    latin, broken = "<p>caf\u00e9 \u00fc</p>".encode("latin-1"), b"<p>ok \xff\xfe</p>"
    sha1 = "sha1:" + "A" * 32
    parts = [
        record(1, latin, "Content-Type: text/html; charset=ISO-8859-1\r\n", f"WARC-Payload-Digest: {sha1}\r\nWARC-Block-Digest: sha1:B\r\n"),
        record(2, broken),
        record(3, "<p>\u4e2d</p>".encode(), 'content-type: text/html;charset="UTF-8"\r\n'),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    rows = warc.derive(warc.read_responses(spark, str(tmp_path / "x.warc.gz")), id_col="position").where("warc_type = 'conversion'").collect()
    sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    found = {r.refers_to[10:-1]: (r.block, r.source_payload_digest, r.stated_payload_digest, r.stated_block_digest) for r in rows}
    assert found == {
        "1": ("caf\u00e9 \u00fc", sha(latin), sha1, "sha1:B"),
        "2": ("ok \ufffd\ufffd", sha(broken), None, None),
        "3": ("\u4e2d", sha("<p>\u4e2d</p>".encode()), None, None),
    }
