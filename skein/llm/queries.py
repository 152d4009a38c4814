"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontamination, exact_dedup, language_id, license_scan, sharding, simhash, substring_dedup, suffix_dedup, url_filter
from skein.llm.storage import Workspace, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, Workspace(spark, "digests").path)
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), index).drop("known")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), *how), *how)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    # The checksum is taken before the exchange, so that no text has to ride through it.
    placed = sharding.shard(table(spark, sf_dir, "documents").withColumn("text_crc32", crc))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_strings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
             d AS (SELECT doc_id, points, sha256(t) AS text_sha256 FROM n)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
               text_sha256
        FROM d""",
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
             w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
             s AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS pos, words FROM d),
             h AS (SELECT doc_id, pos, md5_number(array_to_string(list_slice(words, pos, pos + 34), ' ')) AS run FROM s),
             r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY run) > 1 AS again FROM h),
             c AS (SELECT w.doc_id, w.pos, w.word,
                          coalesce(bool_or(r.again) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
                   FROM w LEFT JOIN r USING (doc_id, pos)),
             k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
                   FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op10_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS data, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
             h AS (SELECT doc_id, pos, md5_number(array_slice(data, pos, pos + 99)) AS run
                   FROM (SELECT doc_id, data, unnest(range(1, n_bytes - 98)) AS pos FROM d)),
             r AS (SELECT doc_id, pos, (doc_id, pos) <> min((doc_id, pos)) OVER (PARTITION BY run) AS again FROM h),
             c AS (SELECT doc_id, pos, again, lag(pos) OVER near AS before FROM r WHERE again WINDOW near AS (PARTITION BY doc_id ORDER BY pos)),
             e AS (SELECT doc_id, pos, sum(CASE WHEN pos - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM c),
             g AS (SELECT doc_id, span, min(pos) AS first, max(pos) + 99 AS last FROM e GROUP BY doc_id, span),
             k AS (SELECT doc_id, sum(last - first + 1)::BIGINT AS n_removed, count(*) AS n_spans, list({'a': first, 'b': last} ORDER BY first) AS gone FROM g GROUP BY doc_id)
        SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(CASE WHEN gone IS NULL THEN data ELSE unhex(array_to_string(
                   [hex(array_slice(data, CASE WHEN i = 1 THEN 1 ELSE gone[i - 1].b + 1 END, CASE WHEN i > len(gone) THEN n_bytes ELSE gone[i].a - 1 END))
                    FOR i IN range(1, len(gone) + 2)], '')) END) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
}
