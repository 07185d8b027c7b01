"""Packing of tokenised documents into sequences of fixed length, online and in bounded space.

Each task keeps a fixed number of open windows. A document goes, whole where it can, into
the open window it fits best; when none has room the fullest is emitted. What is still open
at the end of the tasks is merged: laid end to end and cut into full sequences.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.batches import bounded
from chainlens.session import stored

LENGTH, WINDOWS, SLACK, END_ID = 4096, 32, 16, 2
CACHED_WORDS, CACHED_BYTES = 250_000, 48
OUT_BYTES = 4 << 20
MERGED = 1 << 62  # sequence ids of merged leftovers start here

SCHEMA = ("doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "task long, before long")


class Kept(dict):
    """A dict of two generations of at most ``most`` keys; what is still asked for moves to the younger."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def lacks(self, keys: Iterable) -> list:
        """The keys in neither generation."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        out = []
        for key in set(keys):
            if key in self:
                continue
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self[key] = value
        return out


# Characters below this one have no marks to compose and one lower case whatever stands
# around them; but for the two that get longer.
SIMPLE = "\u0180"
NOT_SIMPLE = "\u0130\u0149"
GAP, CUT = re.compile("[ \t-\r]"), 1 << 18  # long texts are worked on in runs up to a gap
# What a tokeniser file must say for its words to be parted here.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def _packed(ids: Iterable[int]) -> bytes:
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit numbers, each followed by the end id.

    The tokeniser drops white space, and no token, normal form or lower case depends on what
    stands beyond it. So the ids of a text are those of its words, one after the other.
    Where all characters are simple, the file's own pattern parts them and each part not met
    before is given to its model; other words, and all words of files with other steps, go
    through the whole tokeniser.
    """

    def __init__(self, path: str, end_id: int = END_ID, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.known, self.end = self.tokenizer.model, Kept(most), _packed([end_id])
        says = json.loads(self.tokenizer.to_str())
        steps = (says.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = (says.get("normalizer") or {}).get("normalizers") == NORMAL and len(steps) == 2 and (
            steps[0].get("type"), steps[0].get("behavior"), steps[0].get("invert")) == ("Split", "Removed", True) and (
            BYTES.items() <= steps[1].items())
        # The file's pattern with the classes of simple characters written out.
        kinds = [(chr(c), unicodedata.category(chr(c))[0]) for c in range(ord(SIMPLE))]
        classes = {r"\p{L}": "".join(c for c, k in kinds if k == "L"), r"\p{N}": "".join(c for c, k in kinds if k == "N"),
                   r"\s": "\t-\r \x85\xa0"}
        said = steps[0]["pattern"]["Regex"] if known else ""
        for name, letters in classes.items():
            said = said.replace(name, letters)
        self.pattern = re.compile(said) if known else None
        self.special = [t["content"] for t in says.get("added_tokens") or []]
        # Bytes as characters: printable ones stand for themselves, others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {x: 256 + i for i, x in enumerate(x for x in range(256) if x not in shown)}

    def _simple(self, text: str) -> bool:
        return self.pattern is not None and (text.isascii() or (max(text) < SIMPLE and not any(
            c in text for c in NOT_SIMPLE))) and not any(t in text for t in self.special)

    def _parts(self, text: str) -> list[bytes]:
        parts, known = self.pattern.findall(text.lower()), self.known
        extra = {}
        for part in known.lacks(parts):
            shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
            (known if len(part) <= CACHED_BYTES else extra)[part] = _packed(t.id for t in self.model.tokenize(shown))
        return [extra[p] if p in extra else known[p] for p in parts] if extra else list(map(known.__getitem__, parts))

    def _piece(self, text: str) -> list[bytes]:
        if self._simple(text):
            return self._parts(text)
        words = re.split("[ \t-\r]+", text)
        simple = [self._simple(w) if w else True for w in words]
        other = list(dict.fromkeys(w for w, s in zip(words, simple) if not s))
        found = self.tokenizer.encode_batch(other, add_special_tokens=False) if other else []
        ids = {w: _packed(t.ids) for w, t in zip(other, found)}
        out = []
        for is_simple, run in groupby(zip(words, simple), key=lambda x: x[1]):
            if is_simple:
                out += self._parts(" ".join(w for w, _ in run))
            else:
                out += [ids[w] for w, _ in run]
        return out

    def of(self, text: str | None) -> bytes:
        text, at, out = text or "", 0, []
        while at < len(text):
            gap = GAP.search(text, at + CUT) if len(text) - at > CUT else None
            end = gap.end() if gap else len(text)
            out.append(b"".join(self._piece(text[at:end])))
            at = end
        return b"".join([*out, self.end])


@lru_cache(maxsize=1)
def _ids(path: str, end_id: int) -> Ids:
    """One per Python worker, so that its words serve the next task as well."""
    return Ids(path, end_id)


class Windows:
    """At most ``most`` open windows of ``length`` ids; ``emitted`` collects (serial, pieces) of closed ones."""

    def __init__(self, length: int, most: int, slack: int):
        self.length, self.most, self.slack = length, most, slack
        self.free: list[tuple[int, int]] = []  # (room left, serial), sorted
        self.held: dict[int, list] = {}
        self.serial, self.emitted = 0, []

    def _close(self, serial: int) -> None:
        self.emitted.append((serial, self.held.pop(serial)))

    def _open(self) -> int:
        self.serial += 1
        self.held[self.serial] = []
        return self.serial

    def _put(self, room: int, serial: int, piece: tuple, size: int) -> None:
        """A piece into a window that is not in ``free`` just now."""
        self.held[serial].append((self.length - room, size, piece))
        if size == room:
            self._close(serial)
        else:
            insort(self.free, (room - size, serial))

    def add(self, doc: tuple, start: int, end: int) -> None:
        """The ids [start, end) of a document."""
        while end - start >= self.length:
            self._put(self.length, self._open(), (doc, start), self.length)
            start += self.length
        while start < end:
            size = end - start
            at = bisect_left(self.free, (size, -1))
            if at < len(self.free):  # the least room that holds it
                room, serial = self.free.pop(at)
            elif len(self.free) < self.most:
                room, serial = self.length, self._open()
            else:  # the fullest goes; more than ``slack`` of room is filled first
                room, serial = self.free.pop(0)
                if room > self.slack:
                    self._put(room, serial, (doc, start), room)
                    start += room
                else:
                    self._close(serial)
                continue
            self._put(room, serial, (doc, start), size)
            start = end


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def online(docs: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = WINDOWS, slack: int = SLACK,
           end_id: int = END_ID) -> DataFrame:
    """The pieces of the first step: of emitted windows (``sequence_id``), and of those left open at a task's end.

    The latter have no ``sequence_id`` and stand ``before`` ids behind their task's first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids, state, schema = _ids(tokenizer, end_id), Windows(length, windows, slack), None
        rows, size = [], 0

        def pieces(serial, held, before=None):
            for offset, n, ((doc_id, tokens, total), start) in held:
                part = tokens[4 * start:4 * (start + n)]
                sequence = (task << 33) + serial if before is None else None
                yield doc_id, start, n, part, total, sequence, offset, task, None if before is None else before + offset

        for batch in batches:
            if schema is None:
                schema = pa.schema([pa.field("doc_id", batch.schema.field("doc_id").type)] + [
                    pa.field(c, pa.binary() if c == "ids" else pa.int64())
                    for c in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "task", "before")])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                tokens = ids.of(text.as_py())
                state.add((doc_id, tokens, len(tokens) // 4), 0, len(tokens) // 4)
                for closed in state.emitted:
                    for row in pieces(*closed):
                        rows.append(row)
                        size += len(row[3]) + 100
                        if size > OUT_BYTES:
                            yield _rows(schema, rows)
                            rows, size = [], 0
                state.emitted.clear()
        before = 0
        for _, serial in state.free:
            held = state.held[serial]
            rows += pieces(serial, held, before)
            before += held[-1][0] + held[-1][1]
        if rows:
            yield _rows(schema, rows)

    return bounded(docs.select("doc_id", "text")).mapInArrow(run, SCHEMA.format(kind))


def merged(left: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of windows left open, laid end to end over all tasks and cut at every ``length`` ids.

    The last, incomplete run is cut at powers of two, which need no padding.
    """
    totals = left.groupBy("task").agg(F.sum("length").alias("n")).collect()  # one number a task
    starts, total = {}, 0
    for task, n in sorted(map(tuple, totals)):
        starts[task], total = total, total + n
    spark = left.sparkSession
    begins = spark.createDataFrame(list(starts.items()), "task long, first long")
    full = total // length
    tail = [full * length]
    for power in reversed(range(length.bit_length())):
        if (total - full * length) >> power & 1:
            tail.append(tail[-1] + (1 << power))
    place = left.join(begins, "task").withColumn("at", F.col("first") + F.col("before"))
    at, end = F.col("at"), F.col("at") + F.col("length")
    inner = F.concat(F.transform(F.sequence(F.floor(at / length) + 1, F.floor(at / length) + 2), lambda k: k * length),
                     F.lit(tail).cast("array<long>"))
    cuts = F.sort_array(F.array_distinct(F.filter(
        inner, lambda c: (c > at) & (c < end) & ((c % length == 0) & (c <= full * length) | (c > full * length)))))
    edges = F.concat(F.array(at), cuts, F.array(end))
    parts = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda a, i: F.struct(a.alias("a"), F.get(edges, i + 1).alias("b")))
    rows = place.select("*", F.explode(parts).alias("part"))
    skipped, size = F.col("part.a") - at, F.col("part.b") - F.col("part.a")
    behind = F.col("part.a") >= full * length
    number = F.size(F.filter(F.lit(tail).cast("array<long>"), lambda c: c <= F.col("part.a"))) - 1
    first = F.when(behind, F.get(F.lit(tail).cast("array<long>"), number)).otherwise(
        F.floor(F.col("part.a") / length) * length)
    sequence = F.when(behind, full + number).otherwise(F.floor(F.col("part.a") / length))
    return rows.select(
        "doc_id", (F.col("start") + skipped).alias("start"), size.alias("length"),
        F.substring("ids", (4 * skipped + 1).cast("int"), (4 * size).cast("int")).alias("ids"), "doc_tokens",
        (sequence + F.lit(MERGED)).alias("sequence_id"), (F.col("part.a") - first).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = WINDOWS, slack: int = SLACK,
         end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the pieces of all documents (doc_id, text).

    A document is the ids of its text by the tokeniser file ``tokenizer`` and ``end_id``;
    ``ids`` are little-endian unsigned 32-bit numbers. A sequence's pieces lie without gaps
    from 0; those emitted online end at most ``slack`` ids short of ``length``, merged
    ones are full, but for at most one of each smaller power of two. Documents are cut where
    they exceed ``length``, where a window must be filled up, or in merging; each id is in one piece.

    A task holds ``windows`` windows and one batch. Very long texts are cut into windows as
    they come; one word is tokenised as a whole. A null or empty text is the end id alone.
    Rows without doc_id, or with the same one, are packed each for itself. Other columns are not
    looked at; an empty table gives an empty result. The order of the rows decides what shares a
    sequence; the same files, read in the same splits, give the same sequences.
    """
    placed = stored(online(docs, tokenizer, length, windows, slack, end_id), "pieces")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return placed.where("sequence_id is not null").select(*names).unionByName(
        merged(placed.where("sequence_id is null"), length))


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, lengths, ids) of packed pieces: ids in place, padded unless a power of two long.

    A sequence is put together in one task; it has at most ``length`` ids. ``lengths`` are those of
    its pieces, in order.
    """
    rows = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_ids"), F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda have, p: F.concat(have, p["ids"]))
    size = F.when(F.bit_count("n_ids") == 1, F.col("n_ids")).otherwise(F.lit(length)).cast("int")
    padding = F.lit(np.array([pad_id], "<u4").tobytes())
    return rows.select("sequence_id", "n_ids", F.transform("p", lambda p: p["length"]).alias("lengths"),
                       F.rpad(joined, 4 * size, padding).alias("ids"))
