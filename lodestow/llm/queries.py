"""One query for each operator over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestow.llm import chat, decontaminate, fingerprints, folds, langid, mixing, passages, quality, simhash, substrings, warc
from lodestow.llm.base import documents, table


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    predicted = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return predicted.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.read_back(chat.expand(rows)))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.summary(documents(spark, sf_dir), 400)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(documents(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage twice, once for either of its documents, so that doc_id has every document with one."""
    found = table(passages.shared_passages(documents(spark, sf_dir)))
    turned = {"doc_id": "partner_id", "start_word": "partner_start", "n_words": "partner_words"}
    both = turned | {b: a for a, b in turned.items()}
    return found.unionByName(found.select(*[F.col(both.get(c, c)).alias(c) for c in found.columns]))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), radius=3, width=3)


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality": op2_quality,
    "op3_langid": op3_langid,
    "op4_chat": op4_chat,
    "op5_substrings": op5_substrings,
    "op6_warc": op6_warc,
    "op7_passages": op7_passages,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op4_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), formatted AS (
  SELECT *, '<turn role="' || role || '">' || chr(10) || regexp_replace(text, '(\\*</?turn)', '\\\1', 'g') || chr(10) || '</turn>' || chr(10) AS f FROM rows
), sums AS (
  SELECT *, sum(length(f)) OVER w AS upto, role = 'assistant' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS example
  FROM formatted WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (example))::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant')::BIGINT AS n_targets
FROM sums GROUP BY conv_id
""",
    "op6_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY d) AS kept FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < kept THEN kept END AS refers_to
FROM k
""",
    "op10_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sizes GROUP BY source
), filled AS (
  SELECT *, source_size / weight AS turn, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), levels AS (
  SELECT (SELECT level FROM filled WHERE level * weight < 2.0 * source_size ORDER BY turn, source NULLS LAST LIMIT 1) AS level
), targets AS (
  SELECT source, source_size::BIGINT AS source_size, coalesce(least(2.0 * source_size, l.level * weight), 2.0 * source_size)::DOUBLE AS target FROM filled, levels l
), wanted AS (
  SELECT doc_id, size, source_size, target, s.source, CASE WHEN size > 0 THEN least(2.0, target / source_size) ELSE 0 END AS copies,
    (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, floor(copies) AS sure, CASE WHEN copies > floor(copies) THEN (u / (1 - u)) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS rank FROM wanted
), summed AS (
  SELECT *, target - sum(size * sure) OVER (PARTITION BY source) AS need,
    sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM ranked
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (sure + CASE WHEN rank IS NOT NULL AND running - size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed
""",
}
