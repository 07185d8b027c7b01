"""Personal data by a skip-chain conditional random field.

Patterns give base spans, which stay. The field adds spans: its nodes are the tokens with
a digit or ``@`` (all other tokens are ``O`` by construction), its edges join neighbours and
repeated or similar tokens of a document, however far apart. Tokens in base spans are
observed; loopy message passing carries their labels to the others, so that a number
given once in full form is also found where it stands in another form.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.batches import bounded

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
CERTAIN, ROUNDS, DAMPING = 0.95, 30, 0.5
TAIL, MOST_DIGITS = 7, 21  # last digits that make numbers similar; of a card or phone with a trunk prefix

# Patterns of the kinds; possessive digits and look-behinds keep the same matches in linear time.
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_MARK = re.compile("[0-9@]")
_DIGITS = re.compile("[0-9]")
_TRIM = ".,;:!?()[]{}<>\"'`|"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d - 9 if (d := 2 * int(c)) > 9 else d for c in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: the local part is the whole run before an @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL_BACK.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns that hold their check, by start and kind."""
    if not _MARK.search(text):
        return []
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _shape(token: str) -> int:
    """One of 96 coarse shapes: what a token is made of and how many digits it has."""
    digits = len(_DIGITS.findall(token))
    size = int(np.searchsorted((1, 4, 7, 9, 12, 16, 20), digits, "right")) if digits else 0
    letters = any(c.isalpha() for c in token)
    return size * 12 + ("@" in token) * 6 + letters * 3 + (2 if "." in token else 1 if "-" in token else 0)


def _key(token: str) -> str:
    """Equal for repeated and similar tokens: numbers by their digits, others by their lower-case text."""
    token = token.strip(_TRIM)
    if "@" not in token and not any(c.isalpha() for c in token):
        return "".join(_DIGITS.findall(token)).lstrip("0")
    return token.lower()


def _number(token: str) -> str:
    """The digits of a token without letters and @, else nothing."""
    return "" if "@" in token or any(c.isalpha() for c in token) else "".join(_DIGITS.findall(token))


def _grouped(text: str, free: list[tuple[int, int, int]], numbers: dict[str, int]) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """Free tokens, where runs of digit groups that repeat a number or its end are one node; shapes of repeats by start.

    ``numbers`` has the digits of base spans and their shapes. Groups may lack the
    number's first digits, or have zeros before. Of each last group the longest run
    counts. A repeat has the shape of what it repeats, however it is written.
    """
    tails = {n[k:]: shape for n, shape in numbers.items() for k in range(len(n) - TAIL + 1)}
    shapes: dict[int, int] = {}
    if not tails:
        return free, shapes
    digits = [_number(text[s:e]) for s, e, _ in free]
    out, i = [], len(free) - 1
    while i >= 0:
        seen, first, k, shape = "", i, i, None
        while digits[k] and len(seen) + len(digits[k]) <= MOST_DIGITS:
            seen = digits[k] + seen
            like = tails.get(seen, tails.get(seen.lstrip("0")))
            if like is not None:
                first, shape = k, like
            if k == 0 or free[k][0] - free[k - 1][1] > 2:
                break
            k -= 1
        out.append((free[first][0], free[i][1], -1))
        if shape is not None:
            shapes[free[first][0]] = shape
        i = first - 1
    return out[::-1], shapes


def nodes(text: str, base: list[tuple[str, int, int]]) -> dict[str, np.ndarray] | None:
    """Tokens of a text: start, end, shape, label (-1: not in a base span) and edges.

    A base span is one node, so that a number written in groups equals one written
    without; other tokens that it does not touch are nodes of their own, or in groups if
    they repeat a card or phone. Skip edges join equal keys, and numbers with the same
    last seven digits.
    """
    spans, free = [], []
    for kind, s, e in base:
        if not spans or s >= spans[-1][1]:  # of overlapping base spans the first stands for the text
            spans.append((s, e, KINDS.index(kind) + 1))
    k = 0
    for m in _NODE.finditer(text):
        token = m[0].strip(_TRIM)
        if not token:
            continue
        s = m.start() + m[0].index(token)
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if k == len(spans) or spans[k][0] >= s + len(token):
            free.append((s, s + len(token), -1))
    numbers = {_number(text[s:e]): _shape(text[s:e]) for s, e, kind in spans if LABELS[kind] in ("card", "phone")}
    free, shapes = _grouped(text, free, numbers)
    every = sorted(spans + free)
    if not every:
        return None
    start, end, label = (np.array(x) for x in zip(*every))
    keys = [_key(text[s:e]) for s, e, _ in every]
    ends = [n[-TAIL:] if len(n) >= TAIL else "" for n in (_number(text[s:e]) for s, e, _ in every)]
    shape = np.array([shapes[s] if s in shapes else _shape(text[s:e]) for s, e, _ in every])
    chain = np.flatnonzero(start[1:] - end[:-1] <= 2)
    last: dict[str, int] = {}
    alike: dict[str, int] = {}
    skips = []
    for i, (key, tail) in enumerate(zip(keys, ends)):  # each to the ones before: two edges a node at most
        if len(key) >= 4:
            if key in last:
                skips.append((last[key], i))
            if tail and tail in alike and alike[tail] != last.get(key):
                skips.append((alike[tail], i))
            last[key] = i
            if tail:
                alike[tail] = i
    return {"start": start, "end": end, "label": label, "shape": shape, "chain": np.stack([chain, chain + 1], 1),
            "skip": np.array(skips, np.int64).reshape(-1, 2), "keys": np.array(keys, object),
            "ends": np.array(ends, object)}


def observations(docs: DataFrame) -> DataFrame:
    """(shape, label, before, behind, same, n): counts of tokens by their label and their neighbours'.

    Over all documents; a free token that repeats one of a base span, or its last digits, has
    no known label and is left out. At most 96 x 5 x 6 x 6 x 6 rows, summed in each task first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for cell in batch.column("text"):
                text = cell.as_py()
                if not text or not _MARK.search(text):
                    continue
                g = nodes(text, base_spans(text))
                if g is None:
                    continue
                label = np.maximum(g["label"], 0)
                known = {k for k, y in zip(g["keys"], g["label"]) if y > 0}
                known |= {t for t, y in zip(g["ends"], g["label"]) if y > 0 and t}
                usable = [y > 0 or not (k in known or t in known) for k, t, y in zip(g["keys"], g["ends"], g["label"])]
                sides = np.full((3, len(label)), 5)  # 5: no such neighbour
                sides[0][g["chain"][:, 1]] = label[g["chain"][:, 0]]
                sides[1][g["chain"][:, 0]] = label[g["chain"][:, 1]]
                sides[2][g["skip"][:, 0]] = label[g["skip"][:, 1]]
                sides[2][g["skip"][:, 1]] = label[g["skip"][:, 0]]
                seen.update(t for t, u in zip(zip(g["shape"].tolist(), label.tolist(), *sides.tolist()), usable) if u)
        rows = list(zip(*[(*k, n) for k, n in seen.items()]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names)

    names = ["shape", "label", "before", "behind", "same", "n"]
    sums = bounded(docs.select("text")).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return sums.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def fitted(counts: DataFrame, steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights by pseudo-likelihood: shape x label, and label x label of chain and skip edges.

    Gradient steps of fixed number over the counted configurations; both edge tables are
    symmetric. Without observations all weights are 0.
    """
    rows = np.array([tuple(r) for r in counts.orderBy(*counts.columns).collect()], np.int64).reshape(-1, 6)
    w = {"shape": np.zeros((96, 5)), "chain": np.zeros((5, 5)), "skip": np.zeros((5, 5))}
    if not len(rows):
        return w
    shape, label, before, behind, same, n = rows.T
    # Each label counts alike: else the many free tokens outweigh all kinds.
    weight = n / np.bincount(label, n, 5)[label] / len(set(label.tolist()))
    target = np.eye(5)[label]
    hot = {"before": np.eye(6)[before][:, :5], "behind": np.eye(6)[behind][:, :5], "same": np.eye(6)[same][:, :5]}
    speed = {k: np.full_like(v, 1e-8) for k, v in w.items()}
    for _ in range(steps):
        score = w["shape"][shape] + (hot["before"] + hot["behind"]) @ w["chain"] + hot["same"] @ w["skip"]
        p = np.exp(score - score.max(1, keepdims=True))
        miss = (target - p / p.sum(1, keepdims=True)) * weight[:, None]
        grad = {"shape": np.zeros((96, 5)), "chain": (hot["before"] + hot["behind"]).T @ miss, "skip": hot["same"].T @ miss}
        np.add.at(grad["shape"], shape, miss)
        for k in w:
            if k != "shape":
                grad[k] = (grad[k] + grad[k].T) / 2
            grad[k] -= ridge * w[k] / w[k].shape[0]
            speed[k] += grad[k] ** 2
            w[k] += rate * grad[k] / np.sqrt(speed[k])
    return w


def marginals(g: dict[str, np.ndarray], w: dict[str, np.ndarray]) -> np.ndarray:
    """Label probabilities of the nodes by damped loopy message passing, in rounds of a fixed limit."""
    own = w["shape"][g["shape"]].copy()
    seen = g["label"] > 0
    own[seen] = -50.0
    own[np.flatnonzero(seen), g["label"][seen]] = 0.0
    edges = np.concatenate([g["chain"], g["skip"]])
    if not len(edges):
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    tables = np.concatenate([np.repeat(w["chain"][None], len(g["chain"]), 0), np.repeat(w["skip"][None], len(g["skip"]), 0)])
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    sent = np.zeros((len(src), 5))
    for _ in range(ROUNDS):
        belief = own.copy()
        np.add.at(belief, dst, sent)
        rest = belief[src] - sent[back]
        new = np.logaddexp.reduce(rest[:, :, None] + tables, axis=1)
        new -= new.max(1, keepdims=True)
        if np.abs(new - sent).max() < 1e-4:
            break
        sent = DAMPING * sent + (1 - DAMPING) * new
    belief = own.copy()
    np.add.at(belief, dst, sent)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], w: dict[str, np.ndarray],
                certain: float = CERTAIN) -> list[tuple[str, int, int]]:
    """Free tokens that the field labels, with at least the probability ``certain``."""
    if not _MARK.search(text):
        return []
    g = nodes(text, base)
    if g is None or not (g["label"] < 0).any():
        return []
    p = marginals(g, w)
    best = p.argmax(1)
    chosen = np.flatnonzero((g["label"] < 0) & (best > 0) & (p.max(1) >= certain))
    return [(LABELS[best[i]], int(g["start"][i]), int(g["end"][i])) for i in chosen]


def find(docs: DataFrame, weights: dict[str, np.ndarray], certain: float = CERTAIN) -> DataFrame:
    """The documents with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans.

    ``spans`` lists kind:start:end of base and added spans by start and kind, in code
    points, end exclusive. Null texts count as empty. Columns of these names are replaced,
    others stay; repeated rows get equal results; an empty table gives an empty result.
    """
    ours = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    docs = docs.drop(*ours)
    names = docs.columns

    def one(text: str | None) -> tuple:
        base = base_spans(text or "")
        spans = sorted({*base, *added_spans(text or "", base, weights, certain)}, key=lambda s: (s[1], KINDS.index(s[0])))
        kinds = Counter(k for k, _, _ in base)
        return (*[kinds[k] for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*[one(t.as_py()) for t in batch.column("text")])) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(m, k) for m, k in zip(made, kinds)]], [*names, *ours])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + [f"n_{k} long" for k in KINDS] + ["base_sha256 string", "spans string"])
    return bounded(docs).mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans, overlapping ones as one, replaced by the kind in capitals and brackets."""
    out, at = [], 0
    runs: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([kind, s, e])
    for kind, s, e in runs:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: dict[str, np.ndarray], certain: float = CERTAIN) -> DataFrame:
    """The documents with their personal data replaced in ``text`` and n_chars, if there, counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t in batch.column("text"):
                text = t.as_py()
                base = base_spans(text or "")
                spans = [*base, *added_spans(text or "", base, weights, certain)]
                texts.append(redacted(text, spans) if spans else text)
            at = names.index("text")
            columns = [*batch.columns[:at], pa.array(texts, batch.schema.field("text").type), *batch.columns[at + 1:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = bounded(docs).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
