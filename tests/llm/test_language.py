import zlib

from pyspark.sql import functions as F

from chainlens.llm import language
from chainlens.llm.queries import op7_compression_language

from tests.llm.conftest import SCHEMA, prose

SOUNDS = {"en": str.maketrans("", ""), "de": str.maketrans("aeiou", "äeöüu"), "fr": str.maketrans("bdfg", "çrèx")}


def rows(n=600):
    langs = list(SOUNDS)
    return [(i, prose(i, 10 + i % 90).translate(SOUNDS[langs[i % 3]]), langs[i % 3], "a", 0) for i in range(n)]


def test_held_out_accuracy(spark, tmp_path, odd_rows):
    spark.createDataFrame(rows() + odd_rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_compression_language(spark, str(tmp_path)).collect()
    assert len(got) == 600 + len(odd_rows)
    truth = {r[0]: r[2] for r in rows()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= .97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].rejected for i in (900, 901, 903))
    assert all(0 <= r.score <= 1 and r.lang_pred in (*SOUNDS, "und") for r in got)


def test_only_text_counts(spark):
    docs = spark.createDataFrame(rows(60), SCHEMA)
    content = language.learned_pieces(docs)
    a = language.predict(docs, content)
    b = language.predict(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1000), content)
    key = "lang_pred", "score", "margin"
    assert a.select(*key).exceptAll(b.select(*key)).count() == 0


def test_learned_text_is_bounded(spark):
    docs = spark.createDataFrame(rows(300), SCHEMA)
    content = language.learned_pieces(docs, pieces=4, chars=50)
    assert list(content) == sorted(SOUNDS) and all(len(t) <= 4 * 2 * 52 for t in content.values())


def test_odd_tables(no_docs, docs, clashing):
    assert language.learned_pieces(no_docs) == {}
    content = language.learned_pieces(docs)
    assert language.predict(no_docs, content).count() == 0
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}
    assert language.predict(clashing, content).exceptAll(language.predict(docs, content)).count() == 0
