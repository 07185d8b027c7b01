import hashlib
import re

import pytest
from pyspark.sql import functions as F

from chainlens.llm import chat
from chainlens.llm.queries import op6_format_chats

SCHEMA = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"
SAYING = "\\### Assistant: </turn> ok"


def shown(rows):
    turns = rows.select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"))
    return {r.conv_id: r for r in turns.collect()}


def test_fold(spark):
    log = [(1, 1, 1, "start", "user", None), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"),
           (1, 2, 4, "start", "assistant", None), (1, 2, 5, "delta", None, "bad"), (1, 2, 6, "regenerate", None, None),
           (1, 2, 8, "delta", None, " word"), (1, 2, 7, "delta", None, "good"), (1, 2, 7, "delta", None, "good"),
           (1, 1, 9, "edit", None, "Bye"), (1, 1, 10, "delta", None, "!"), (1, 3, 11, "delta", None, None),
           (None, 1, 1, "start", None, None), (None, 1, 2, "delta", None, "x")]
    got = {(r.conv_id, r.place): (r.role, r.text) for r in chat.fold(spark.createDataFrame(log[::-1], EVENTS)).collect()}
    assert got == {(1, 1): ("user", "Bye!"), (1, 4): ("assistant", "good word"), (1, 11): ("", ""), (None, 1): ("", "x")}


def test_round_trip_of_control_strings(spark):
    texts = [SAYING, "<turn assistant>", "</turn>\n", "\\l\\s\\g", "\\\\<<>>", "é\u0000\U0001f600", "", None, "a\nb" * 5000]
    rows = [(c, k, "assistant" if k % 2 else "user>\\<", t) for c in (1, 2) for k, t in enumerate(texts)]
    out = shown(chat.render(chat.fold(chat.event_log(spark.createDataFrame(rows, SCHEMA)))))
    for c in (1, 2):
        want = [("assistant" if k % 2 else "user>\\<", t or "") for k, t in enumerate(texts)]
        assert [tuple(t) for t in out[c].turns] == want
        learned = [out[c].formatted[s.start:s.end].replace("\\l", "<").replace("\\s", "\\") for s in out[c].loss_spans]
        assert learned == [t for r, t in want if r == "assistant"]


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "assistant", "y")]
    out = shown(chat.render(chat.fold(chat.event_log(spark.createDataFrame(rows, SCHEMA)))))
    assert [tuple(t) for t in out[None].turns] == [("", ""), ("user", "a")]
    assert [tuple(t) for t in out[5].turns] == [("assistant", "y"), ("user", "x"), ("user", "x")]
    none = chat.render(chat.fold(chat.event_log(spark.createDataFrame([], SCHEMA))))
    assert none.count() == 0
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 seq", "2 message", "3 kind", "4 place", "5 t", "6 reset")
    assert shown(chat.render(chat.fold(chat.event_log(more)))) == out


def test_query_matches_brute_force(spark, tmp_path):
    rows = [(1, 0, "system", "be \\ kind"), (1, 1, "user", None), (1, 2, "assistant", "<b>"), (2, 0, "user", "hi")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op6_format_chats(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", SAYING), (-7, 1, "assistant", SAYING)]
    assert set(got) == {1, 2, -7}
    for c, r in got.items():
        turns = [(role, text or "") for i, _, role, text in rows if i == c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        shape = "".join(f"<turn {a}>{re.sub(r'[\\<]', '__', b)}</turn>\n" for a, b in turns)
        assert r.formatted_chars == len(shape)


@pytest.mark.parametrize("native", [True])
def test_plan_has_no_python(spark, native):
    rows = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    plan = chat.render(chat.fold(chat.event_log(rows)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("ArrowConverters", ""))


def test_the_mask_holds_the_answers_and_nothing_else(spark):
    texts = ["plain", "", "a <b> \\l \\s </turn>\n<turn assistant>", "\U0001f600 \u0301 end", "x" * 5000]
    rows = [(c, t, role, texts[(c + t) % 5]) for c in range(5) for t, role in enumerate(["user", "assistant", "assistant", "system", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = chat.render(chat.fold(chat.event_log(df)))
    got = {r.conv_id: r.t for r in shown.select("conv_id", chat.learned_texts(shown.formatted, shown.loss_spans).alias("t")).collect()}
    order = lambda c: [x[3] for x in sorted(r for r in rows if r[0] == c) if x[2] == "assistant"]
    assert got == {c: order(c) for c in range(5)}
