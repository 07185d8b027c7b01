"""Language identification by compression.

Each language has a raw-content zstandard dictionary of learned text. A text belongs to
the language whose dictionary makes it smallest; narrow margins are marked as rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.llm.batches import bounded

PIECES, PIECE_CHARS, LEVELS, MARGIN = 128, 1000, (3, 6), 0.02
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    """Lower-case words with single spaces between them, and around them."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def learned_pieces(docs: DataFrame, pieces: int = PIECES, chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Dictionary content by language, from documents (text, lang).

    A fixed number of pieces a language: texts are dealt by their hash into ``pieces``
    bins, and of each bin the text of smallest hash (one of 200 characters or more, if
    there is any) gives ``chars`` characters from a place that the hash names. So the driver gets ``pieces * chars`` characters a language.
    """
    h = F.xxhash64("text")
    size = F.char_length("text")
    at = F.pmod(F.shiftright(h, 20), F.greatest(F.lit(1), size - chars)).cast("int") + 1
    rows = docs.where("lang is not null and text is not null").select(
        "lang", F.pmod(h, F.lit(pieces)).alias("bin"), F.struct(size < 200, h, F.substring("text", at, F.lit(chars))).alias("s"))
    best = rows.groupBy("lang", "bin").agg(F.min("s").alias("s")).select("lang", "bin", "s.col3").collect()
    out: dict[str, list[tuple[int, str]]] = {}
    for lang, place, text in best:
        if (text := normal(text)).strip():
            out.setdefault(lang, []).append((place, text))
    return {lang: "".join(t for _, t in sorted(texts)).encode() for lang, texts in sorted(out.items())}


def predict(docs: DataFrame, content: dict[str, bytes], levels: tuple[int, ...] = LEVELS, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of whole texts (doc_id, text).

    A form's size is the sum over ``levels``; two levels split more ties of short texts.
    ``lang_pred`` is the language of the smallest compressed form (of equal ones the first
    by name), ``und`` for null texts, texts without a letter, and where nothing was
    learned. ``score`` weighs a byte of difference as one unit of log odds; ``margin`` is
    the next language's excess size as a share, and ``rejected`` marks margins below the
    given one. Rows that are repeated get equal results; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    langs = list(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for lang in langs:
            tools.append([])
            for level in levels:
                book = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                book.precompute_compress(level=level)
                tools[-1].append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_dict_id=False))

        def one(text: str | None) -> tuple[str, float, float]:
            if text is None or not tools or not any(map(str.isalpha, text)):
                return "und", 0.0, 0.0
            raw = normal(text).encode()
            sizes = [sum(len(t.compress(raw)) for t in row) for row in tools]
            best = min(sizes)
            odds = sum(math.exp(max(best - s, -700)) for s in sizes)
            others = sorted(sizes)
            gap = (others[1] - best) / best if len(others) > 1 else 1.0
            return langs[sizes.index(best)], 1 / odds, gap

        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # bounds the texts held as Python strings
                part = batch.slice(a, 256)
                rows = [one(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "lang_pred": [r[0] for r in rows],
                    "score": [r[1] for r in rows], "margin": [r[2] for r in rows],
                    "rejected": [r[0] == "und" or r[2] < margin for r in rows]})

    return bounded(docs.select("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
