import gzip
import random
import struct
import time
import zlib

import pytest

from chainlens.llm import tiff, warc


def response(body, *headers):
    lines = "".join(f"{h}\r\n" for h in headers)
    return warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/")],
                      f"HTTP/1.1 200 OK\r\n{lines}\r\n".encode() + body)


@pytest.mark.parametrize("size", [b"-6", b"+6", b"0x6", b"6_0", b"", b"zz", b"f" * 40])
def test_sizes_of_chunks_that_are_no_numbers(size):
    with pytest.raises(ValueError):
        warc.derive(response(size + b"\r\nabcdef\r\n0\r\n\r\n", "Transfer-Encoding: chunked"))


def test_chunks_and_codings_are_undone():
    text = b"<title>t</title><p>some text"
    chunked = b"5;x=1\r\n" + text[:5] + b"\r\n" + b"%x\r\n" % (len(text) - 5) + text[5:] + b"\r\n0\r\n\r\n"
    for body, header in ((chunked, "Transfer-Encoding: chunked"), (gzip.compress(text[:9]) + gzip.compress(text[9:]), "Content-Encoding: gzip"),
                         (zlib.compress(text), "Content-Encoding: deflate"), (text, "X: y")):
        assert warc.parse_http(warc.parse(response(body, header))[1])[3] == text


def test_bodies_that_decode_to_too_much(monkeypatch):
    monkeypatch.setattr(warc, "MOST_BODY", 1000)
    assert len(warc.parse_http(warc.parse(response(gzip.compress(bytes(1000)), "Content-Encoding: gzip"))[1])[3]) == 1000
    for body in (gzip.compress(bytes(1001)), gzip.compress(bytes(600)) * 2, gzip.compress(b"abc" * 99)[:-9]):
        with pytest.raises(ValueError):
            warc.derive(response(body, "Content-Encoding: gzip"))


def test_many_titles_take_linear_time():
    start = time.process_time()
    assert warc.links("<title>" * 60_000, "http://a/")[0] is None
    assert warc.links("<title>a</title>" * 20_000, "http://a/")[0] == "a"
    assert time.process_time() - start < 5


def file(width=3, height=2, **changed):
    tags = {256: (4, 1, width), 257: (4, 1, height), 258: (3, 1, 8), 259: (3, 1, 1), 273: (4, 1, 8), 277: (3, 1, 1),
            278: (4, 1, height), 279: (4, 1, 6)} | {int(k[1:]): v for k, v in changed.items()}
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, *v) for t, v in sorted(tags.items())) + bytes(4)
    return struct.pack("<2sHI", b"II", 42, 14) + b"abcdef" + body


def test_damaged_files_give_error_rows():
    page, = tiff.read_pages(file())
    assert page["error"] is None and page["pixels"] == b"abcdef"
    for data in (file(t277=(3, 0, 1)), file(1 << 22, 1 << 22), file(t277=(3, 1, 0)), file(t273=(4, 0, 8)), file(t279=(4, 1 << 31, 6)),
                 file(t278=(4, 1, 0)), file(t258=(3, 0, 8)), file((1 << 32) - 1, (1 << 32) - 1, t278=(4, 1, 1)), b"", None, b"II*"):
        page, = tiff.read_pages(data)
        assert page["error"] and page["pixels"] is None


def test_random_changes_of_bytes():
    rng = random.Random(11)
    image, html = file(), b"<title>t</title><a href='x'>y</a>" * 3
    record = response(gzip.compress(html), "Content-Encoding: gzip", "Content-Type: text/html")
    chunks = response(b"21\r\n" + html[:33] + b"\r\n0\r\n\r\n", "Transfer-Encoding: chunked")
    for _ in range(1500):
        data = bytearray(rng.choice([image, record, chunks]))
        tiff_like = data[:2] == b"II"
        for _ in range(rng.randrange(1, 5)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        if tiff_like:
            assert all(p["error"] or len(p["pixels"]) == p["width"] * p["height"] * p["samples"] * p["bits"] // 8
                       for p in tiff.read_pages(bytes(data)))
        else:
            try:
                warc.derive(bytes(data))
            except (ValueError, KeyError, OSError, EOFError, zlib.error):
                pass
