"""TIFF images in binary columns: one row per page, and a writer for lossless byte payloads.

Reading follows the chain of image directories of both byte orders and decodes strips or
tiles that are stored plain, by PackBits, LZW or deflate, with the horizontal (8, 16 and
32 bits) and floating-point predictors undone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chainlens.llm.batches import bounded

PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, PAGE_ROWS = 576, 8
# Compression, predictor, strip rows or tile (width, rows) of the pages that are written, in turn.
LAYOUTS = ((DEFLATE, 2, 4), (PACKBITS, 1, 3), (LZW, 2, (192, 16)), (DEFLATE, 1, (144, 16)))
# Fixed values of the format: bytes of each field type and its struct code.
FIELD_TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}
WIDTH_TAG, HEIGHT_TAG, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES = (
    256, 257, 258, 259, 262, 273, 277, 278, 279)
PLANES, PREDICTOR, TILE_WIDTH, TILE_ROWS, TILES, TILE_SIZES, FORMAT = 284, 317, 322, 323, 324, 325, 339


def packbits_encode(data: bytes) -> bytes:
    """Runs of three bytes or more become (count, byte); all else is copied."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    out, literal = bytearray(), 0

    def copy(until: int) -> None:
        for at in range(literal, until, 128):
            part = data[at:min(at + 128, until)]
            out.append(len(part) - 1)
            out.extend(part)

    long_runs = np.flatnonzero(np.diff(starts) >= 3)
    for s, e in zip(starts[long_runs].tolist(), starts[long_runs + 1].tolist()):
        copy(s)
        for at in range(s, e, 128):
            n = min(128, e - at)
            out += bytes((257 - n, data[s])) if n > 1 else bytes((0, data[s]))
        literal = e
    copy(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1:at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1:at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; widths grow one code early, as readers expect."""
    out, bits, held, width, free = bytearray(), 256, 9, 9, 258  # begins with the clear code
    table: dict[int, int] = {}
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        bits = bits << width | prefix
        held += width
        table[key] = free
        free += 1
        prefix = byte
        if free == 4094:
            bits = bits << width | 256
            held += width
            table.clear()
            width, free = 9, 258
        elif free in (512, 1024, 2048):
            width += 1
        if held > 512:
            rest = held & 7
            out += (bits >> rest).to_bytes(held >> 3, "big")
            bits &= (1 << rest) - 1
            held = rest
    if prefix >= 0:
        bits = bits << width | prefix
        held += width
        free += 1
        if free in (512, 1024, 2048):
            width += 1
    bits = bits << width | 257
    held += width
    pad = -held % 8
    return bytes(out) + (bits << pad).to_bytes((held + pad) >> 3, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, total = single.copy(), [], 0
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        bits = bits << 8 | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 256:
            table, width, last = single.copy(), 9, b""
            continue
        if code == 257 or total >= size:
            break
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        total += len(entry)
        if last:
            table.append(last + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        last = entry
    return b"".join(out)


def decompress(data: bytes, how: int, size: int) -> bytes:
    if how == PLAIN:
        return data
    if how == PACKBITS:
        return packbits_decode(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {how} is not read")


def compress(data: bytes, how: int) -> bytes:
    return {PLAIN: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: zlib.compress}[how](data)


def undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """``block`` is rows x columns x samples; sums along the row give the samples back."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3 and block.dtype.kind == "f":
        rows, columns, samples = block.shape
        planes = np.cumsum(block.reshape(rows, -1).view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, block.dtype.itemsize, columns * samples)  # most significant bytes first
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{block.dtype.itemsize}").reshape(
            rows, columns, samples).astype(block.dtype)
    raise ValueError(f"predictor {predictor} is not read")


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a circle")
        seen.add(at)
        n, = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELD_TYPES:
                continue
            if not count:
                raise ValueError(f"tag {tag} is empty")
            size, code = FIELD_TYPES[kind]
            place = at + 10 + 12 * k
            if size * count > 4:
                place, = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        yield order, tags
        at, = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


# No code read here gives more bytes for one: a code of LZW has 1.5 bytes and stands for less than 4,096.
MOST_RATIO = 4096


def _pixels(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples = one(WIDTH_TAG, 0), one(HEIGHT_TAG, 0), one(SAMPLES, 1)
    bits, how, predictor = set(tags.get(BITS, (1,))), one(COMPRESSION, 1), one(PREDICTOR, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if len(bits) != 1 or kind is None or min(bits) not in (8, 16, 32, 64) or width * height < 1 or samples < 1:
        raise ValueError("samples of this kind are not read")
    dtype = np.dtype(f"{order}{kind}{min(bits) // 8}")
    tiled = TILES in tags
    wide, tall = (one(TILE_WIDTH, 0), one(TILE_ROWS, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    if wide < 1 or tall < 1:
        raise ValueError("empty strips or tiles")
    places, sizes = tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES]
    planes = samples if one(PLANES, 1) == 2 else 1
    inner = samples // planes
    across, down = -(-width // wide), -(-height // tall)
    if len(places) < planes * across * down or len(sizes) < len(places):
        raise ValueError("strips or tiles are missing")
    if width * height * samples * dtype.itemsize > MOST_RATIO * len(data):
        raise ValueError("the file is too short for its pixels")
    image = np.zeros((height, width, samples), dtype)
    for k in range(planes * across * down):
        plane, block = divmod(k, across * down)
        top, left = block // across * tall, block % across * wide
        rows = tall if tiled else min(tall, height - top)
        size = rows * wide * inner * dtype.itemsize
        raw = decompress(data[places[k]:places[k] + sizes[k]], how, size)
        if len(raw) < size:
            raise ValueError("a strip or tile is too short")
        part = undo_predictor(np.frombuffer(raw[:size], dtype).reshape(rows, wide, inner), predictor, order)
        part = part[:height - top, :width - left]
        image[top:top + part.shape[0], left:left + part.shape[1], plane * inner:(plane + 1) * inner] = part
    return image


def read_pages(data: bytes | None) -> Iterator[dict]:
    """The pages of one file; a damaged one ends with a row that has only ``error``."""
    page = 0
    try:
        for order, tags in _directories(data or b""):
            image = _pixels(data, order, tags)
            yield {"page": page, "width": image.shape[1], "height": image.shape[0], "samples": image.shape[2],
                   "bits": image.dtype.itemsize * 8, "compression": tags.get(COMPRESSION, (1,))[0],
                   "predictor": tags.get(PREDICTOR, (1,))[0], "pixels": image.tobytes(), "error": None}
            page += 1
    except (ValueError, KeyError, IndexError, OverflowError, struct.error, zlib.error) as e:
        yield dict.fromkeys(("width", "height", "samples", "bits", "compression", "predictor", "pixels")) | {
            "page": page, "error": f"{type(e).__name__}: {e}"}


def _page(image: np.ndarray, layout: tuple, at: int) -> tuple[bytes, int]:
    """Directory and data of one page of 8-bit samples that stands at ``at``; where its next-pointer is."""
    how, predictor, shape = layout
    height, width = image.shape
    wide, tall = shape if isinstance(shape, tuple) else (width, shape)
    blocks = []
    for top in range(0, height, tall):
        for left in range(0, width, wide):
            part = image[top:top + tall, left:left + wide]
            if isinstance(shape, tuple) and part.shape != (tall, wide):
                part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1])), "edge")
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            blocks.append(compress(part.tobytes(), how))
    tags = [(WIDTH_TAG, 4, [width]), (HEIGHT_TAG, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [how]),
            (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
    n = len(blocks)
    if isinstance(shape, tuple):
        tags += [(TILE_WIDTH, 4, [wide]), (TILE_ROWS, 4, [tall]), (TILES, 4, [0] * n), (TILE_SIZES, 4, [*map(len, blocks)])]
    else:
        tags += [(STRIPS, 4, [0] * n), (STRIP_ROWS, 4, [tall]), (STRIP_SIZES, 4, [*map(len, blocks)])]
    tags.sort()
    after = at + 2 + 12 * len(tags) + 4  # lists of values, then the blocks
    lists = 8 * n if n > 1 else 0
    starts = (after + lists + np.cumsum([0, *map(len, blocks[:-1])])).tolist()
    head, tail = struct.pack("<H", len(tags)), b""
    for tag, kind, values in tags:
        values = starts if tag in (TILES, STRIPS) else values
        packed = struct.pack(f"<{len(values)}{FIELD_TYPES[kind][1]}", *values)
        if len(packed) > 4:
            packed, tail = struct.pack("<I", after + len(tail)), tail + packed
        head += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return head + b"\0\0\0\0" + tail + b"".join(blocks), at + len(head)


def write_pages(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS, layouts=LAYOUTS) -> bytes:
    """A file of 8-bit grey pages whose samples, page after page, are the payload.

    The payload's length is a positive multiple of ``width``.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for k, top in enumerate(range(0, len(image), page_rows)):
        if len(out) % 2:
            out += b"\0"
        out[link:link + 4] = struct.pack("<I", len(out))
        page, link = _page(image[top:top + page_rows], layouts[k % len(layouts)], len(out))
        out += page
    return bytes(out)


def padded(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    """Bytes of the text, and these with bytes 255 up to a positive multiple of ``unit``."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (unit - len(raw) if not raw else -len(raw) % unit)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of documents (doc_id, text): each text as the samples of a TIFF file.

    Null and empty texts become one row of 255. Other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):  # bounds the files held at once
                part = batch.slice(a, 64)
                texts = [padded(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": [n for n, _ in texts],
                    "media": pa.array([write_pages(p) for _, p in texts], pa.binary())})

    return bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def pages(images: DataFrame) -> DataFrame:
    """One row per page of the files in ``media``, with the other columns beside it.

    Adds page, width, height, samples, bits, compression, predictor, pixels (rows of
    samples in the file's byte order) and error. A null or damaged file gives the pages
    before the damage and a row that has only page and error. Columns of these names are
    replaced; repeated rows each give their pages.
    """
    names = ["page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "error"]
    images = images.drop(*names)
    others = [f for f in images.schema.fields if f.name != "media"]
    kinds = [pa.int32()] * 7 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, media in enumerate(batch.column("media")):
                rows = list(read_pages(media.as_py()))
                beside = [batch.column(f.name).take(pa.array([i] * len(rows))) for f in others]
                yield pa.RecordBatch.from_arrays(
                    [*beside, *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]],
                    [*[f.name for f in others], *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    ours = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"
    return bounded(images).mapInArrow(run, f"{schema}, {ours}" if others else ours)


def features(images: DataFrame) -> DataFrame:
    """One row per file (doc_id, n_bytes, media): digests of its pages' samples and of the file.

    ``feature`` holds the number of pages, samples, their sum and the sum of steps along rows.
    Pages are read one after the other, so a file's pixels are never held at once. A
    damaged file gives the digests of the pages before the damage and its error.
    """
    kind = images.schema["doc_id"].dataType.simpleString()

    def one(media: bytes) -> tuple:
        sha, size, tail, count, total, steps, error = hashlib.sha256(), 0, b"", 0, 0, 0, None
        for page in read_pages(media):
            if page["error"]:
                error = page["error"]
                break
            pixels = page["pixels"]
            sha.update(pixels)
            size, count, tail = size + len(pixels), count + 1, (tail + pixels)[-32:]
            grey = np.frombuffer(pixels, np.uint8).reshape(page["height"], -1).astype(np.int64)
            total += int(grey.sum())
            steps += int(np.abs(np.diff(grey, axis=1)).sum())
        return size, sha.hexdigest(), zlib.crc32(tail), f"{count}:{size}:{total}:{steps}", error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [m.as_py() or b"" for m in batch.column("media")]
            rows = [one(m) for m in media]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                "payload_bytes": [r[0] for r in rows], "payload_sha256": [r[1] for r in rows],
                "tail_crc32": [r[2] for r in rows], "media_bytes": [len(m) for m in media],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "feature": [r[3] for r in rows],
                "error": pa.array([r[4] for r in rows], pa.string())})

    return bounded(images.select("doc_id", "n_bytes", "media")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
             "media_bytes long, media_sha256 string, feature string, error string")
