"""The operators as queries on the given tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm import (chat, circulant, crf, language, merkle, mixing, negatives, packing, paragraphs, passages, quality,
                           spaced, tiff, warc)

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, path: str) -> DataFrame:
    return quality.resample(_read(spark, path, "documents").select("doc_id", "text"), _read(spark, path, "labels")).select(
        "doc_id", "log_weight", "score", "kept")


def op2_decontaminate(spark: SparkSession, path: str) -> DataFrame:
    return spaced.overlaps(_read(spark, path, "documents"), _read(spark, path, "benchmark"),
                           tolerant_from=spaced.LEAST_TOKENS).select(
        "doc_id", "item_id", "n_tokens", "n_matched")


def op3_mix_sources(spark: SparkSession, path: str) -> DataFrame:
    return mixing.allocate(_read(spark, path, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op4_tiff_pages(spark: SparkSession, path: str) -> DataFrame:
    stored_texts = tiff.store_texts(_read(spark, path, "documents").select("doc_id", "text"))
    return tiff.features(stored_texts).drop("error")


def op5_warc_derivatives(spark: SparkSession, path: str) -> DataFrame:
    return warc.derivatives(warc.responses(_read(spark, path, "pages"))).select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "source_digest", "digest_ok", "block_digest",
        "content_length", "n_links", F.sha2("record", 256).alias("record_sha256"))


def op6_format_chats(spark: SparkSession, path: str) -> DataFrame:
    saying = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"),
                 F.lit(saying).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("m")).select("m.*")
    rows = _read(spark, path, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    shown = chat.render(chat.fold(chat.event_log(rows)))
    turns = shown.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                         F.array_join(chat.learned_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    line = F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"), "loss",
                        F.char_length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP6_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
   sum(15 + length(role) + length(text) + 2 * length(role) - length(replace(replace(role, '<', ''), '\', ''))
     - length(replace(role, '>', '')) + length(text) - length(replace(replace(text, '<', ''), '\', ''))) AS n
   FROM c GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256,
   CAST(n AS BIGINT) AS formatted_chars FROM a"""


def op7_compression_language(spark: SparkSession, path: str) -> DataFrame:
    docs = _read(spark, path, "documents").select("doc_id", "text", "lang")
    content = language.learned_pieces(docs.where(~language.held_out(F.col("doc_id"))))
    return language.predict(docs, content).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_circulant_minhash(spark: SparkSession, path: str) -> DataFrame:
    return circulant.near_duplicates(_read(spark, path, "documents"))


def op9_repeated_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_read(spark, path, "documents"))


def op9_repeated_passages(spark: SparkSession, path: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, path, "documents"))


def op10_skip_chain_pii(spark: SparkSession, path: str) -> DataFrame:
    docs = _read(spark, path, "documents").select("doc_id", "text")
    return crf.find(docs, crf.fitted(crf.observations(docs))).drop("text")


def op11_merkle_manifest(spark: SparkSession, path: str) -> DataFrame:
    more = F.when(merkle.tampered(), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(_read(spark, path, "documents"), {"n_chars": more})


def op12_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, path, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.mine(negatives.quantised(rows, 256), F.col("vec_id") % 50 == 0)


def op13_pack_windows(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(_read(spark, path, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components_sql(items: str, percent: int) -> str:
    """CTEs from ``items`` (id, text) to ``sets`` (id, n) and ``roots`` (id, root), by all common shingles."""
    return rf"""{items}, words AS (SELECT id, list_filter(regexp_split_to_array({_LOWER.format('text')}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM items),
 full_sets AS (SELECT id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
   ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END AS s FROM words),
 sets AS (SELECT id, len(s) AS n FROM full_sets), each AS (SELECT id, unnest(s) AS x FROM full_sets),
 common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
 links AS (SELECT a, b FROM common JOIN sets p ON p.id = a JOIN sets q ON q.id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
 ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reached(id, root) AS (SELECT id, id FROM items UNION SELECT ends.b, reached.root FROM reached JOIN ends ON ends.a = reached.id WHERE reached.root < ends.b),
 roots AS (SELECT id, min(root) AS root FROM reached GROUP BY id)"""


OP8_SQL = f"""WITH RECURSIVE {_components_sql('items AS (SELECT doc_id AS id, text FROM documents)', 85)}
 SELECT id AS doc_id, n AS n_shingles, root AS component_id, id = root AS kept FROM sets JOIN roots USING (id)"""

OP9_SQL = f"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
 long_lines AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, CAST(line AS INTEGER) AS line, text FROM lines
   WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) >= 50), {_components_sql('items AS (SELECT id, text FROM long_lines)', 80)},
 g AS (SELECT root, count(*) AS n_paragraphs FROM roots GROUP BY root)
 SELECT l.doc_id, l.line, n AS n_shingles, f.doc_id AS first_doc_id, f.line AS first_line, n_paragraphs, l.id <> f.id AS removed
 FROM roots JOIN g USING (root) JOIN long_lines l ON l.id = roots.id JOIN long_lines f ON f.id = root JOIN sets ON sets.id = l.id WHERE n_paragraphs > 1"""


OP11_SQL = """WITH RECURSIVE each AS (SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z,
    list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: CAST(i AS UBIGINT))),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS UBIGINT)) ELSE x // 2 END)) AS crc FROM documents),
  leaves AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || z) AS leaf,
    sha256(a || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || z) AS more,
    coalesce(xor(crc, CAST(4294967295 AS UBIGINT)) % 7 = 0, false) AS hit FROM each),
  placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
  low AS (SELECT lang, 0 AS h, 0 AS level, i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM placed
    UNION ALL SELECT lang, 0, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 1) // 2) FROM low WHERE n > 1 GROUP BY lang, level, i // 2),
  tops AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM low WHERE n = 1),
  high AS (SELECT 0 AS level, g AS i, subroot AS d, count(*) OVER () AS n FROM tops
    UNION ALL SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 1) // 2) FROM high WHERE n > 1 GROUP BY level, i // 2),
  way AS (SELECT p.doc_id, p.i AS k, p.lang, 0 AS level, p.i AS i, CASE WHEN hit THEN more ELSE leaf END AS f, '' AS s FROM placed p
    UNION ALL SELECT w.doc_id, w.k, w.lang, w.level + 1, w.i // 2,
      sha256(CASE WHEN o.d IS NULL THEN w.f WHEN w.i % 2 = 0 THEN w.f || o.d ELSE o.d || w.f END), w.s || coalesce(o.d, '')
    FROM way w JOIN low me ON me.lang IS NOT DISTINCT FROM w.lang AND me.level = w.level AND me.i = w.i AND me.n > 1
    LEFT JOIN low o ON o.lang IS NOT DISTINCT FROM w.lang AND o.level = w.level AND o.i = xor(w.i, 1)),
  up AS (SELECT w.doc_id, w.k, w.lang, 0 AS level, t.g AS i, w.f, w.s FROM way w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.lang
      JOIN low me ON me.lang IS NOT DISTINCT FROM w.lang AND me.level = w.level AND me.n = 1
    UNION ALL SELECT w.doc_id, w.k, w.lang, w.level + 1, w.i // 2,
      sha256(CASE WHEN o.d IS NULL THEN w.f WHEN w.i % 2 = 0 THEN w.f || o.d ELSE o.d || w.f END), w.s || coalesce(o.d, '')
    FROM up w JOIN high me ON me.level = w.level AND me.i = w.i AND me.n > 1 LEFT JOIN high o ON o.level = w.level AND o.i = xor(w.i, 1)),
  ends AS (SELECT u.* FROM up u JOIN high h ON h.level = u.level AND h.n = 1)
 SELECT p.doc_id, p.leaf, t.subroot, h.d AS root, sha256(e.s) AS proof_sha256, e.f AS folded_root, e.f = h.d AS verified
 FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang JOIN ends e ON e.k = p.i AND e.lang IS NOT DISTINCT FROM p.lang
   JOIN high h ON h.n = 1"""

OP12_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
   vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
 WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_importance_resampling, op2_decontaminate, op3_mix_sources, op4_tiff_pages, op5_warc_derivatives,
    op6_format_chats, op7_compression_language, op8_circulant_minhash, op9_repeated_paragraphs, op9_repeated_passages,
    op10_skip_chain_pii, op11_merkle_manifest, op12_hard_negatives, op13_pack_windows)}
ORACLE: dict[str, str] = {"op6_format_chats": OP6_SQL, "op8_circulant_minhash": OP8_SQL, "op9_repeated_paragraphs": OP9_SQL,
                          "op11_merkle_manifest": OP11_SQL, "op12_hard_negatives": OP12_SQL}
