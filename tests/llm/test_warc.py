import gzip
import json

from chainlens.llm import warc
from chainlens.llm.queries import op5_warc_derivatives

PAGE = """<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no -->
<a href="/x">one</a><a class=b href='http://e.org/y?a=1&amp;b=2'>two</a><img src=pic.png><p>First   line<br>second <b>bold</b> 1 &lt; 2</p></body></html>"""


def response(body=PAGE.encode(), http="HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8", type_="response", **more):
    block = http.encode() + b"\r\n\r\n" + body
    return warc.build([("WARC-Type", type_), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://e.com/d/"),
                       ("WARC-Date", "2020-02-02T00:00:00Z"), ("WARC-IP-Address", "1.2.3.4"),
                       ("WARC-Payload-Digest", more.get("digest", warc.digest(body)))], block)


def test_records_link_to_their_source():
    meta, text = warc.derive(response())
    assert [meta["warc_type"], text["warc_type"]] == ["metadata", "conversion"]
    for r in (meta, text):
        headers, block = warc.parse(r["record"])
        assert headers["WARC-Refers-To"] == "<urn:uuid:1>" and headers["WARC-Record-ID"] == r["record_id"]
        assert headers["WARC-Target-URI"] == "http://e.com/d/" and headers["WARC-IP-Address"] == "1.2.3.4"
        assert headers["WARC-Date"] == "2020-02-02T00:00:00Z"
        assert headers["WARC-Payload-Digest"] == warc.digest(PAGE.encode()) and r["digest_ok"]
        assert headers["WARC-Block-Digest"] == warc.digest(block) == r["block_digest"]
        assert int(headers["Content-Length"]) == len(block) == r["content_length"]
    assert warc.parse(text["record"])[1].decode() == "A & B\nonetwo\nFirst line\nsecond bold 1 < 2"
    inside = json.loads(warc.parse(meta["record"])[1])
    assert inside["WARC-Header-Metadata"]["WARC-Record-ID"] == "<urn:uuid:1>"
    html = inside["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert html["Head"]["Title"] == "A & B"
    assert [x["url"] for x in html["Links"]] == ["http://e.com/x", "http://e.org/y?a=1&b=2", "http://e.com/d/pic.png"]


def test_codings_and_charsets():
    zipped = gzip.compress("<p>é</p>".encode("latin-1"))
    chunked = b"".join(f"{len(p):x}\r\n".encode() + p + b"\r\n" for p in (zipped[:9], zipped[9:])) + b"0\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip"
    _, text = warc.derive(response(chunked, http))
    assert warc.parse(text["record"])[1].decode() == "é" and text["source_digest"] == warc.digest(chunked)


def test_other_and_damaged_records(spark):
    rows = [(1, response()), (1, response()), (2, response(type_="request")), (3, None), (4, b"junk"), (5, response()[:200]),
            (6, response(digest="sha1:WRONG"))]
    records = spark.createDataFrame([(i, None if r is None else bytearray(r), "own") for i, r in rows],
                                    "page_id long, record binary, error string")
    got = warc.derivatives(records).collect()
    count = lambda i: [r for r in got if r.page_id == i]
    assert len(count(1)) == 4 and len({r.record_id for r in count(1)}) == 2 and not count(2)
    assert all(len(count(i)) == 1 and count(i)[0].error and count(i)[0].record is None for i in (3, 4, 5))
    assert [r.digest_ok for r in count(6)] == [False, False] and {r.source_digest for r in count(6)} == {"sha1:WRONG"}


def test_hostile_pages_take_linear_time():
    for text in ("<" * 300_000, "<a " * 100_000, "<script>" * 50_000, "<!--" * 80_000, "&" * 300_000, "href=" * 60_000):
        assert len(warc.derive(response(text.encode()))) == 2


def test_query(spark, tmp_path):
    rows = [(1, "http://e.com/", PAGE), (2, None, None), (None, "http://e.com/", ""), (1, "http://e.com/", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = op5_warc_derivatives(spark, str(tmp_path)).collect()
    assert len(got) == 8 and all(r.digest_ok for r in got)
    assert {r.content_length for r in got if r.page_id is None and r.warc_type == "conversion"} == {0}
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
