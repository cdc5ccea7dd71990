"""Thin queries over the supplied tables, one for each corpus operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, filter_audit, jaccard_join, line_rules, media, merkle, oracles, packing, pii, quality_classifier, sharding, simhash, token_counts, warc
from .common import Scratch, held_out, table

TOKEN_LIMIT = 1024


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_line_rules(table(spark, sf_dir, "documents"), cleaned=False).drop("cleaned")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media_rows = media.read_png(media.write_png(table(spark, sf_dir, "documents")))
    return media_rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("png").cast("long").alias("media_bytes"),
        F.sha2("png", 256).alias("media_sha256"),
        F.lower(F.hex("dct_hash")).alias("feature"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = Scratch(spark, "warc").path("archive")
    warc.write_archives(table(spark, sf_dir, "pages"), archive)
    return warc.read_archives(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs).select("kept.doc_id", "text", "n_entities")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link_documents(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle.prove_documents(table(spark, sf_dir, "documents"), checked)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_packing": op6_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_media": op8_media,
    "op9_warc": op9_warc,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_simhash": op11_simhash,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op12_filter_audit": oracles.FILTER_AUDIT,
    "op13_merkle": oracles.merkle_sql(),
    "op9_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), latest AS (
            SELECT payload, max(page_id) AS latest FROM p WHERE payload_bytes >= 1000 GROUP BY payload
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN latest IS NULL OR latest IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN latest IS DISTINCT FROM page_id THEN latest END AS refers_to
        FROM p LEFT JOIN latest USING (payload)
    """,
}
