"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.llm import html, langid, lines, negatives, packing, quality, sharding, simhash, syncmers, tokenizing, toxicity, warc, whitening
from inkmark.llm.common import new_folder, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    archive = warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, archive)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), **packing.PRODUCTION).withColumnRenamed("id", "doc_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    shown = [syncmers.digits(F.col(c)).alias(n) for c, n in (("own", "fingerprint"), ("edited", "edited_fingerprint"))]
    return found.select("doc_id", "n_chars", "edited_sha256", *shown, "near_edited", "near_next")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.keep_ledger(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", *quality.MEASURES, "fail_bits", (~quality.passes(F.col("fail_bits"), "base")).alias("base_failed"), quality.passes(F.col("fail_bits")).alias("kept"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each version of the policy rejects, alone and beside the others."""
    return quality.ablations(quality.keep_ledger(table(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 40).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = rows.select("vec_id", label.alias("label"), whitening.whole("embedding", 256).alias("x"))
    return negatives.mine(own, F.col("vec_id") % 50 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whitening.whole("embedding", 64, 1_000_000).alias("x"))
    return whitening.whiten(rows).withColumnRenamed("id", "vec_id")


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs), spans=True).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html": op2_html,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_bpe": op7_bpe,
    "op8_syncmers": op8_syncmers,
    "op9_quality": op9_quality,
    "quality_ablation": quality_ablation,
    "op10_sharding": op10_sharding,
    "op11_negatives": op11_negatives,
    "op12_whitening": op12_whitening,
    "op13_langid": op13_langid,
}

_LEDGER_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM t, unnest(range(1, len(w) - 1)) AS r(i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM places),
covered AS (SELECT DISTINCT doc_id, i + k AS at FROM again, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
         len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_upper
  FROM t LEFT JOIN repeats USING (doc_id)),
b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
             + 8 * (100 * n_upper > 40 * word_chars)::INT + 16 * (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)::INT
             + 32 * (word_chars > 20 * n_words)::INT)::BIGINT AS fail_bits
  FROM m)"""

ORACLE_SQL: dict[str, str] = {
    "op4_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, h.payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h LEFT JOIN f ON h.payload_digest = f.payload_digest AND payload_bytes >= 100""",
    "op9_quality": _LEDGER_SQL
    + """
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b""",
    "quality_ablation": _LEDGER_SQL
    + """,
policies(policy, mask) AS (VALUES ('base', 3), ('2025-1', 15), ('2025-2', 63)),
rules(rule, bit) AS (VALUES ('few_words', 1), ('repeats', 2), ('symbols', 4), ('shouting', 8), ('same_lines', 16), ('long_words', 32))
SELECT policy, rule, count(*) FILTER ((fail_bits & bit) <> 0) AS n_failed, count(*) FILTER ((fail_bits & mask) = bit) AS n_only,
       count(*) FILTER ((fail_bits & mask) IN (0, bit)) AS n_kept_without
FROM b, policies, rules WHERE (mask & bit) <> 0 GROUP BY 1, 2""",
    "op11_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
w AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score),
r AS (SELECT *, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank FROM w)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3""",
}
