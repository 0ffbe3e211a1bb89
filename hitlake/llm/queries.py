"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.llm import alignment, host_rules, language_id, lexical, lm_scoring, lz_fingerprint, mixing, packing, quality_cnn, secrets, simhash, suffix_dedup, warc
from hitlake.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that `labels` marks as good quality."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = lm_scoring.marked(docs, good)
    return lm_scoring.score_documents(rows, lm_scoring.fit(rows))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    net = quality_cnn.train(quality_cnn.sample_texts(docs, labels))
    return quality_cnn.score_documents(docs, net).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_hash", "row_hash")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("url")


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.verdicts(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("host_rate", "fail_chance")})


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are taken from the ids of the packed pieces; the ids stay out of the result."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_id", F.col("item_id").cast("bigint"))


def language_rows(docs: DataFrame) -> DataFrame:
    """Predictions of a model learned from the rows that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return language_id.predict(docs, language_id.fit(docs.where(~held_out))).withColumn("held_out", held_out)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_rows(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_lm_scoring, op3_suffix_dedup, op4_quality, op5_mixing, op6_warc, op7_host_rules, op8_lz_fingerprint, op9_packing, op10_simhash, op11_lexical_search, op12_language_id, op13_alignment)}

_BLANK = r"[\x20\x09-\x0D]+"
_NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: For the queries that SQL can express; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
""",
    "op7_host_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, [w FOR w IN string_split_regex(coalesce(text, ''), '{_BLANK}') IF w <> ''] AS words,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_replace(x, '{_BLANK}', '', 'g') <> ''] AS lines FROM documents),
tri AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 4)),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, t) > 1) CROSS JOIN range(3) r(k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov ON cov.rid = d.rid),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > word_chars OR 100 * n_dup_lines > 30 * n_words AS strict_failed FROM m),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed OR strict_failed) AS failures FROM j GROUP BY source),
s AS (SELECT avg(failures::DOUBLE / docs) AS mean, var_pop(failures::DOUBLE / docs) AS spread, avg(1::DOUBLE / docs) AS thin FROM h),
q AS (SELECT mean, greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * thin, mean * (1 - mean) / 1000, 1e-9::DOUBLE) - 1, 1e-3::DOUBLE) AS strength FROM s),
r AS (SELECT source, (failures + mean * strength + 0.5::DOUBLE) / (docs + strength + 1) AS rate FROM h, q),
x AS (SELECT j.*, rate, (20 * n_symbols) / greatest(word_chars, 1) + (20 * n_dup_lines) / (3 * greatest(n_words, 1)) AS share FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, rate * (share * share * share * share) AS fails FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fails / (fails + (1 - rate)) <= 0.5::DOUBLE AS kept, round(rate, 6) AS host_rate, round(fails / (fails + (1 - rate)), 6) AS fail_chance FROM c
""",
    "op11_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, [t FOR t IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NO_TERM}') IF t <> ''] AS terms FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, list_distinct([t FOR t IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NO_TERM}') IF t <> '']) AS terms FROM benchmark),
g AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(terms) AS t FROM d) WHERE t IN (SELECT unnest(terms) FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, g GROUP BY t),
m AS (SELECT rid, doc_id, 100 - 90 + ((90 * len(terms) * docs) // total) AS m FROM d, g WHERE len(terms) > 0),
s AS (SELECT qid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM (SELECT qid, item_id, unnest(terms) AS t FROM q) JOIN w USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY ALL)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) <= 10
""",
}
