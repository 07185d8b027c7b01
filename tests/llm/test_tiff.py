import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from chainlens.llm import tiff
from chainlens.llm.queries import op4_tiff_pages


@pytest.mark.parametrize("how", [tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_codecs_round_trip(how):
    rng = random.Random(how)
    for n in (0, 1, 2, 129, 600, 5000, 40_000):
        for kinds in (1, 2, 20, 256):
            data = bytes(rng.randrange(kinds) for _ in range(n))
            assert tiff.decompress(tiff.compress(data, how), how, n) == data


def test_known_codes():
    # The example of the published PackBits note, and an LZW stream written by hand: clear, 7, 258, 8, end.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed, 24).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257))
    assert tiff.lzw_decode(int(bits.ljust(48, "0"), 2).to_bytes(6, "big"), 4) == bytes((7, 7, 7, 8))


def image(order, dtype, predictor, planes, data, width, height, samples):
    """A file of one plain strip a plane, written apart from the library."""
    blocks = [data] if planes == 1 else [np.ascontiguousarray(data[:, :, s:s + 1]) for s in range(samples)]
    raw = []
    for b in blocks:
        if predictor == 2:
            b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(dtype)
        elif predictor == 3:
            n = dtype.itemsize
            p = np.ascontiguousarray(b.astype(f">f{n}")).view(np.uint8).reshape(height, -1, n).transpose(0, 2, 1).reshape(height, -1, b.shape[2])
            b = np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1).astype(np.uint8)
        raw.append(b.astype(b.dtype).tobytes())
    tags = [(256, 3, [width]), (257, 3, [height]), (258, 3, [dtype.itemsize * 8] * samples), (259, 3, [1]),
            (273, 4, None), (277, 3, [samples]), (278, 3, [height]), (279, 4, [len(r) for r in raw]),
            (284, 3, [planes]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]] * samples)]
    at, lists = 8 + 2 + 12 * len(tags) + 4, b""
    places = at + 200
    starts = [places + sum(len(r) for r in raw[:k]) for k in range(len(raw))]
    head = struct.pack(order + "H", len(tags))
    for tag, kind, values in tags:
        values = starts if values is None else values
        packed = struct.pack(order + f"{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(packed) > 4:
            lists, packed = lists + packed, struct.pack(order + "I", at + len(lists))
        head += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(order + "HI", 42, 8) + head + b"\0" * 4 + lists.ljust(200, b"\0") + b"".join(raw)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind, predictor", [("u1", 1), ("u1", 2), ("u2", 2), ("i4", 2), ("f4", 1), ("f4", 3), ("f8", 3)])
@pytest.mark.parametrize("samples, planes", [(1, 1), (3, 1), (3, 2)])
def test_predictors_orders_and_planes(order, kind, predictor, samples, planes):
    dtype = np.dtype(order + kind)
    data = np.random.default_rng(1).integers(0, 200, (5, 7, samples)).astype(dtype)
    page, = tiff.read_pages(image(order, dtype, predictor, planes, data, 7, 5, samples))
    assert page["error"] is None
    assert (np.frombuffer(page["pixels"], dtype).reshape(5, 7, samples) == data).all()


def test_pages_strips_and_tiles(spark):
    payload = bytes(random.Random(3).choices(b"abcd  efg", k=576 * 37))
    media = tiff.write_pages(payload)
    files = spark.createDataFrame([(1, bytearray(media), "own"), (2, bytearray(media[:900]), "own"), (3, None, "own"),
                                   (4, bytearray(b"not an image"), "own"), (1, bytearray(media), "own")],
                                  "id long, media binary, width string")
    rows = tiff.pages(files).collect()
    first = sorted((r for r in rows if r.id == 1), key=lambda r: r.page)[::2]
    assert b"".join(bytes(r.pixels) for r in first) == payload
    assert [(r.compression, r.predictor) for r in first] == [(tiff.LAYOUTS[k % 4][0], tiff.LAYOUTS[k % 4][1]) for k in range(5)]
    assert [r.width for r in first] == [576] * 5 and sum(r.height for r in first) == 37
    for i in (2, 3, 4):
        last = max((r for r in rows if r.id == i), key=lambda r: r.page)
        assert last.error and last.pixels is None


def test_circles_end():
    media = bytearray(tiff.write_pages(b"\1" * 576))
    n = struct.unpack_from("<H", media, 8)[0]
    media[10 + 12 * n:14 + 12 * n] = struct.pack("<I", 8)
    assert [p["error"] is None for p in tiff.read_pages(bytes(media))] == [True, False]


def test_query_reads_all_texts_back(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    got = sorted((str(r.doc_id), r) for r in op4_tiff_pages(spark, str(tmp_path)).collect())
    by_text = {}
    assert len(got) == len(texts)
    for (i, text), (j, r) in zip(texts, got):
        raw = text.encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        assert i == j and (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert by_text.setdefault(text, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_empty_table(no_docs):
    files = tiff.store_texts(no_docs)
    assert files.count() == tiff.features(files).count() == tiff.pages(files).count() == 0
