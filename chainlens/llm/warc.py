"""WARC derivatives: metadata and plain-text conversion records of response records.

Both derivatives name the response they come from (WARC-Refers-To), keep its target,
date, address and payload digest, and have record ids that depend on it alone, so that
a repeated task writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from chainlens.llm.batches import bounded

DATE = "2024-01-01T00:00:00Z"
KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Payload-Digest")
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|head|body|blockquote|pre|hr|dd|dt|dl|form|option|td|th)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^<>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title\s*>", re.I)
_CHUNK = re.compile(rb"[0-9A-Fa-f]{1,15}")
MOST_BODY = 1 << 28  # a body that decodes to more bytes is an error
_LINK = re.compile(r"<(a|img|link|iframe)\b([^<>]*)>", re.I)
_ADDRESS = re.compile(r"\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))", re.I)
_BLANK = re.compile(r"[ \t\r\f\v ]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    headers = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in b" \t" and line and out:  # a folded line goes on
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.decode('utf-8', 'replace').strip()}")
        elif b":" in line:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (last of a name wins) and block of a record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(_headers(lines[1:]))
    size = int(headers.get("Content-Length", "-1"))
    if size < 0 or len(rest) < size:
        raise ValueError("the block is cut short")
    return headers, rest[:size]


def _inflated(data: bytes, form: int) -> bytes:
    """Decoded members of a body, one behind the other, of at most ``MOST_BODY`` bytes in all."""
    parts, room = [], MOST_BODY
    while data:
        member = zlib.decompressobj(form)
        parts.append(member.decompress(data, room + 1))
        room -= len(parts[-1])
        if room < 0:
            raise ValueError("the decoded body is too long")
        if not member.eof:
            raise ValueError("the coded body is cut short")
        data = member.unused_data.lstrip(b"\0")  # members may be padded
    return b"".join(parts)


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes]:
    """Status line, headers, payload as sent, and payload without transfer and content coding."""
    head, gap, sent = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"HTTP/"):
        raise ValueError("not an HTTP response")
    headers = _headers(lines[1:])
    by_name = {k.lower(): v.lower() for k, v in headers}
    body = sent
    if "chunked" in by_name.get("transfer-encoding", ""):
        parts, at = [], 0
        while True:
            end = body.find(b"\r\n", at)
            said = body[at:end].split(b";")[0].strip() if end >= 0 else b"0"
            if not _CHUNK.fullmatch(said):
                raise ValueError("a chunk's size is not a number")
            size = int(said, 16)
            if not size:
                break
            parts.append(body[end + 2:end + 2 + size])
            at = end + 4 + size
        body = b"".join(parts)
    coding = by_name.get("content-encoding", "")
    if coding in ("gzip", "deflate"):
        body = _inflated(body, 31 if coding == "gzip" else 15)
    return lines[0].decode("latin-1"), headers, sent, body


def plain_text(page: str) -> str:
    """Visible text: one line per block, blanks folded, without scripts, styles and comments."""
    text = _BREAK.sub("\n", _DROPPED.sub(" ", page))
    text = html.unescape(_TAG.sub("", text))
    lines = (_BLANK.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str, base: str) -> tuple[str | None, list[dict[str, str]]]:
    """Title and the links of a page, with absolute addresses."""
    page = _DROPPED.sub(" ", page)
    begin = _TITLE.search(page)
    end = _TITLE_END.search(page, begin.end()) if begin else None
    found = []
    for tag, inside in _LINK.findall(page):
        if m := _ADDRESS.search(inside):
            address = html.unescape(m[1] or m[2] or m[3] or "")
            try:
                full = urljoin(base, address)
            except ValueError:
                full = address
            found.append({"path": f"{tag.lower()}@{'src' if tag.lower() in ('img', 'iframe') else 'href'}", "url": full})
    return html.unescape(page[begin.end():end.start()]).strip() if end else None, found


def derive(record: bytes) -> list[dict]:
    """The metadata and the conversion record of a response; nothing for other types."""
    headers, block = parse(record)
    if headers.get("WARC-Type") != "response":
        return []
    source = headers["WARC-Record-ID"]
    status, http, sent, body = parse_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    named = re.search(r"charset=\"?([\w-]+)", kind, re.I)
    try:
        page = body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    uri = headers.get("WARC-Target-URI", "")
    payload = headers.get("WARC-Payload-Digest") or digest(sent)
    title, found = links(page, uri)
    envelope = json.dumps({
        "WARC-Header-Metadata": headers, "Format": "WARC",
        "Payload-Metadata": {"Actual-Content-Type": "application/http; msgtype=response", "HTTP-Response-Metadata": {
            "Response-Line": status, "Headers": http, "Entity-Length": len(sent), "Entity-Digest": digest(sent),
            "HTML-Metadata": {"Head": {"Title": title}, "Links": found}}}}, ensure_ascii=False, sort_keys=True).encode()
    beside = [(k, headers[k]) for k in KEPT if k in headers and k != "WARC-Payload-Digest"]
    out = []
    for what, type_, data in (("metadata", "application/json", envelope), ("conversion", "text/plain", plain_text(page).encode())):
        own = record_id(source, what)
        # The payload digest of the source stays on both; the block digest is the derivative's own.
        fields = [("WARC-Type", what), ("WARC-Record-ID", own), ("WARC-Refers-To", source), *beside,
                  ("WARC-Payload-Digest", payload), ("Content-Type", type_)]
        out.append({"warc_type": what, "record_id": own, "refers_to": source, "target_uri": uri,
                    "source_digest": payload, "digest_ok": payload == digest(sent), "block_digest": digest(data),
                    "content_length": len(data), "n_links": len(found) if what == "metadata" else None,
                    "record": build(fields, data), "error": None})
    return out


_FIELDS = {"warc_type": (pa.string(), "string"), "record_id": (pa.string(), "string"), "refers_to": (pa.string(), "string"),
           "target_uri": (pa.string(), "string"), "source_digest": (pa.string(), "string"), "digest_ok": (pa.bool_(), "boolean"),
           "block_digest": (pa.string(), "string"), "content_length": (pa.int64(), "long"), "n_links": (pa.int64(), "long"),
           "record": (pa.binary(), "binary"), "error": (pa.string(), "string")}


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record) of pages (page_id, url, html): each page as a response record.

    Null addresses and pages are empty.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def one(page_id, url: str | None, page: str | None) -> bytes:
        url, body = url or "", (page or "").encode()
        block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body
        return build([("WARC-Type", "response"), ("WARC-Record-ID", record_id(str(page_id), url, digest(body))),
                      ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(body)),
                      ("Content-Type", "application/http; msgtype=response")], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                made = [one(*(x.as_py() for x in row)) for row in zip(*(part.column(c) for c in ("page_id", "url", "html")))]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "record": pa.array(made, pa.binary())})

    return bounded(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kind}, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records in the column ``record``.

    Two rows a response, with the other columns beside them: warc_type, record_id,
    refers_to, target_uri, source_digest, digest_ok (the source's digest holds),
    block_digest, content_length, n_links, record (the new record's bytes), error. Other
    record types give no row; null or damaged records one row that has only an error.
    Repeated rows each give their records, with equal ids. Columns of these names are
    replaced.
    """
    records = records.select(*[c for c in records.columns if c == "record" or c not in _FIELDS])
    others = [f for f in records.schema.fields if f.name != "record"]

    def one(record: bytes | None) -> list[dict]:
        try:
            return derive(record or b"")
        except (ValueError, KeyError, OSError, EOFError, zlib.error) as e:
            return [dict.fromkeys(_FIELDS) | {"error": f"{type(e).__name__}: {e}"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                made = [(i, r) for i, x in enumerate(part.column("record")) for r in one(x.as_py())]
                rows = pa.array([i for i, _ in made], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f.name).take(rows) for f in others],
                     *[pa.array([r[c] for _, r in made], k) for c, (k, _) in _FIELDS.items()]],
                    [*[f.name for f in others], *_FIELDS])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"{c} {k}" for c, (_, k) in _FIELDS.items()]
    return bounded(records).mapInArrow(run, ", ".join(schema))
