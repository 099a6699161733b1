"""The named queries of the subpackage: each operator over its whole table, and the SQL for those that SQL expresses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    bpe, chat_format, embedding_dedup, hard_negatives, line_dedup, lm_score, merkle, mixing, quality, simhash, suffix_dedup,
    turn_repair, url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


HOST_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_rule(*r) for r in HOST_RULES] + list(url_filter.UNWANTED)
    out = url_filter.judge(table(spark, sf_dir, "pages"), rules)
    return out.withColumnRenamed("id", "page_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.KEPT_FROM).cast("int").alias("predicted"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.with_token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(planted, "conv_id long, turn long, role string, text string"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    segments, convs = chat_format.formatted_conversations(rows, path, public_tokenizers.PATTERN)
    read = chat_format.read_back(segments, path, public_tokenizers.PATTERN)
    return convs.join(read, "path_key").select(
        F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows as op13 damages them, by a checksum of id and turn; nulls in it, and in role and text, are one
    space."""
    space = F.lit(" ")
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), space) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))})
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)))
    return rows.withColumn("time", F.explode(times)).drop("kind", "time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = turn_repair.repair_conversations(damaged(rows), rows)
    return out.withColumnRenamed("conv", "conv_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_simhash_near_dedup, op3_url_filters, op4_lm_scoring, op5_suffix_array_dedup, op6_mixing,
        op7_document_fingerprints, op8_quality_classifier, op9_bpe, op10_embedding_near_dedup, op11_hard_negatives,
        op12_chat_formatting, op13_conversation_repair,
    )
}

_MANNER, _OFFERED = ("(" + "|".join(x) + ")" for x in (url_filter.MANNER, url_filter.OFFERED))
_WORDS = "|".join((*url_filter.ALONE, f"{_MANNER}[^a-z0-9]{_OFFERED}", f"{_OFFERED}[^a-z0-9]{_MANNER}"))
_OWN = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
) + " END"
_ALLOWED = ", ".join(f"'{h}{p}'" for v, h, p in HOST_RULES if v == "allow")

ORACLES = {
    "op3_url_filters": f"""
WITH rest AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
ruled AS (SELECT page_id, url, host, path, {_OWN} AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ({_ALLOWED}) THEN 'allow' ELSE 'block' END
            WHEN regexp_matches(url, '(?i)(^|[^a-z0-9])({_WORDS})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}
