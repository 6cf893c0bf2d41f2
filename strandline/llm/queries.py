"""The thin registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, linededup, mixing, pii, quality, queries_vectors, simhash, suffix, urlfilter, util, warc


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = util.table(spark, sf_dir, "pages")
    files = warc.write(warc.plan(pages, "page_id", F.col("html"), F.col("url")), f"{util.shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    found = warc.summaries(warc.chunks(files))
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
        max(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < first_id THEN first_id END AS refers_to
FROM q
"""


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(util.table(spark, sf_dir, "documents"))

    def count(j: int):
        return F.size(F.filter("base", lambda x: x["kind"] == j)).cast("long")

    counts = [count(j).alias(f"n_{k}") for j, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = util.table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held, F.lit(False)))
    train = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return langid.predict(docs, langid.profiles(train))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove(util.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = util.table(spark, sf_dir, "documents"), util.table(spark, sf_dir, "labels")
    seen = quality.narrow(docs)
    judged = quality.judge(seen, quality.calibrate(seen, labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in names])


def op6_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.rates(util.table(spark, sf_dir, "documents"), util.table(spark, sf_dir, "labels"))
    p = [F.col("m_p")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return found.select("doc_id", F.col("m_n").alias("n_tokens"), *p, F.col("m_rate").alias("rate"))


def op7_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(util.table(spark, sf_dir, "pages"))


def op8_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(util.table(spark, sf_dir, "documents"), util.table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS shingle FROM w),
n AS (SELECT id AS item_id, count(*) AS n_item_shingles FROM s WHERE kind = 'i' GROUP BY id),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.shingle = i.shingle GROUP BY 1, 2)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment FROM m JOIN n USING (item_id)
WHERE n_shared / n_item_shingles >= 0.8
"""


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(util.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(util.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed_lines", "text")


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, text, coalesce(source, chr(0)) AS site, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents),
m AS (SELECT *, trim(line, E' \t\n\x0b\x0c\r') AS t,
  regexp_matches(line, '(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){3}[^\x20\x09-\x0D]') AS may FROM l),
b AS (SELECT t FROM m WHERE may GROUP BY t HAVING count(DISTINCT site) >= 10),
k AS (SELECT m.*, may AND b.t IS NOT NULL AS gone FROM m LEFT JOIN b ON m.t = b.t)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM k GROUP BY doc_id, k.text
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


QUERIES = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_pii_skip_chain": op2_pii_skip_chain,
    "op3_rank_order_language": op3_rank_order_language,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_soft_membership_mixing": op6_soft_membership_mixing,
    "op7_url_language_model": op7_url_language_model,
    "op8_minhash_containment": op8_minhash_containment,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_line_site_spread": op10_line_site_spread,
    **queries_vectors.QUERIES,
}
ORACLE_SQL = {
    "op1_warc_chunks": OP1_SQL,
    "op8_minhash_containment": OP8_SQL,
    "op10_line_site_spread": OP10_SQL,
    **queries_vectors.ORACLE_SQL,
}
