import hashlib
import re

import numpy as np
import pytest

from chainlens.llm import crf

from tests.llm.conftest import SCHEMA, prose

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    "mail a.b@x.example.org, b@c, @x.y, q@@r.s.t x@y.z@u.v.w", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111114111111111111111", "+49 (0)30 123-4567 +1 2 +123456789012345678",
    "+4111111111111111 4111111111111111.1.2.3", "é 12 ñ@é.com ü4111111111111111ü", "", "7", "@", "+", "1-" * 50 + "@a.b",
]


def plain(text):
    """Base spans straight from the patterns."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and crf.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert crf.base_spans(text) == plain(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        text = "".join(rng.choice(list("1234567890.@+- ab()é"), rng.integers(1, 60)))
        assert crf.base_spans(text) == plain(text)


def test_hostile_texts_take_linear_time():
    for text in ("a" * 400_000 + "1", "1" * 400_000, "1." * 200_000, "@" * 200_000, "a@" * 200_000, "+1" * 200_000, "+1 " * 100_000):
        crf.added_spans(text, crf.base_spans(text), {k: np.zeros((96 if k == "shape" else 5, 5)) for k in ("shape", "chain", "skip")})


def marked(i):
    phone = f"+49 30 {1000000 + 7919 * i}"
    return f"{prose(i, 20)} call {phone} or later {phone[1:].replace(' ', '')} {prose(i + 1, 9)} room {i % 90 + 10} mail p{i}@ex.org"


@pytest.fixture(scope="module")
def table(spark, odd_rows):
    rows = [(i, marked(i), "en", "a", 0) for i in range(150)]
    rows += [(1000 + i, f"{prose(i, 30)} version {i} of 20{10 + i % 20} p{i}@ex.org and 1.2.3.{i % 250}, again p{i}@ex.org", "en", "a", 0)
             for i in range(150)]
    return spark.createDataFrame(rows + odd_rows, SCHEMA)


def test_skip_edges_carry_labels(table):
    weights = crf.fitted(crf.observations(table))
    rows = {r.doc_id: r for r in crf.find(table, weights).collect() if r.doc_id is not None}
    for i in range(150):
        text, r = marked(i), rows[i]
        base = plain(text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (r.n_phone, r.n_email) == (1, 1)
        number = re.search("(?<=later )[0-9]+", text)
        assert f"phone:{number.start()}:{number.end()}" in r.spans.split(",")
        assert len(r.spans.split(",")) == len(base) + 1  # and room numbers stay
        other = rows[1000 + i]
        assert len(other.spans.split(",")) == 3
    assert all(rows[i].spans == "" for i in (900, 901, 903, 904, 905, 906))


def test_messages_are_exact_on_a_chain():
    """Without circles, message passing gives the exact marginals."""
    from itertools import product
    rng = np.random.default_rng(2)
    w = {"shape": rng.normal(size=(96, 5)), "chain": rng.normal(size=(5, 5)), "skip": rng.normal(size=(5, 5))}
    w["chain"] += w["chain"].T
    w["skip"] += w["skip"].T
    g = {"shape": np.array([3, 40, 7, 90]), "label": np.array([-1, 2, -1, -1]), "chain": np.array([[0, 1], [1, 2]]),
         "skip": np.array([[2, 3]])}
    exact = np.zeros((4, 5))
    for y in product(range(5), repeat=4):
        if y[1] == 2:
            s = sum(w["shape"][a, b] for a, b in zip(g["shape"], y) if True) - w["shape"][40, 2]
            exact[range(4), y] += np.exp(s + w["chain"][y[0], y[1]] + w["chain"][y[1], y[2]] + w["skip"][y[2], y[3]])
    assert np.allclose(crf.marginals(g, w), exact / exact.sum(1, keepdims=True), atol=1e-3)


def test_redaction(table):
    weights = crf.fitted(crf.observations(table))
    rows = {r.doc_id: r for r in crf.redact(table, weights).collect()}
    assert rows[3].n_chars == len(rows[3].text) and rows[3].text.count("[PHONE]") == 2 and rows[3].text.count("[EMAIL]") == 1
    assert not any(crf.base_spans(r.text or "") for r in rows.values())
    assert rows[904].text == prose(70_003, 40_000) and rows[900].text is None


def test_odd_tables(no_docs, docs, clashing):
    weights = crf.fitted(crf.observations(no_docs))
    assert all((x == 0).all() for x in weights.values())
    assert crf.find(no_docs, weights).count() == 0
    out = crf.find(clashing, weights)
    assert out.where("key = 'own key'").count() == docs.count() and "own spans" not in {r.spans for r in out.collect()}
    assert crf.redact(clashing, weights).columns == clashing.columns


def test_grouped_and_shortened_repeats(table):
    weights = crf.fitted(crf.observations(table))
    repeats = ["49 30 1234567", "49 30 123 45 67", "030 1234567", "0049 30 123-4567", "30 123 4567", "(030) 1234567", "301234567"]
    for repeat in repeats:
        text = f"call +49 30 1234567 or later {repeat} in room 12"
        found = [text[s:e] for _, s, e in crf.added_spans(text, crf.base_spans(text), weights)]
        assert found == [repeat.strip("(")]
        assert crf.redacted(text, [*crf.base_spans(text), *crf.added_spans(text, crf.base_spans(text), weights)]).count("[PHONE]") == 2
    text = "+49 30 1234567, rooms 12 49 30 1234567 30 1234567 7 and 49 30 7654321"
    g = crf.nodes(text, crf.base_spans(text))
    assert [text[s:e] for s, e in zip(g["start"], g["end"])] == [
        "+49 30 1234567", "12", "49 30 1234567", "30 1234567", "7", "49", "30", "7654321"]
    assert g["skip"].tolist() == [[0, 2], [2, 3]]


def test_documents_without_base_spans_have_a_field(spark):
    weights = {k: np.zeros((96 if k == "shape" else 5, 5)) for k in ("shape", "chain", "skip")}
    weights["shape"][crf._shape("15550109999"), 4] = 9.0
    docs = spark.createDataFrame([(1, "call 15550109999 now"), (2, "room 12"), (3, None)], "doc_id long, text string")
    assert not crf.base_spans("call 15550109999 now")
    assert {r.doc_id: r.spans for r in crf.find(docs, weights).collect()} == {1: "phone:5:16", 2: "", 3: ""}
    assert {r.doc_id: r.text for r in crf.redact(docs, weights).collect()} == {1: "call [PHONE] now", 2: "room 12", 3: None}
