"""A corpus pipeline: quality filter, line dedup, near-dedup, mixing and encoding, each stage over all the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, line_dedup, mixing, quality, simhash
from quire.llm.common import fresh, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    score = fresh(docs.columns, "quality_score")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, score_col=score)
    return scored.where(F.col(score) >= quality.KEPT_FROM).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks of lines that an earlier one has."""
    aside = {c: fresh(docs.columns, f"{c}_") for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    out = line_dedup.line_dedup(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of three-word shingles that differ in three bits or
    fewer link, as in op2. The row of the smallest id stays, of one id the smallest digest of its text; null ids come
    last. Of rows equal in id and text one stays, whatever else they hold."""
    key = fresh(docs.columns, "row_key")
    digest = F.md5(F.concat_ws(":", F.col("doc_id").isNull().cast("string"), F.col("doc_id").cast("string"), F.col("text").isNull().cast("string"), "text"))
    keyed = docs.withColumn(key, digest)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    groups = simhash.near_duplicates(keyed.select(row.alias("row"), "text"), id_col="row")
    kept = groups.where("id.key = component.key").select(F.col("id.key").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them, some repeated, some not at all."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, and round_trip, whether these decode to the text. Columns of these names are
    replaced."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids, decoded = fresh(docs.columns, "own_ids"), fresh(docs.columns, "own_decoded")
    out = bpe.with_tokens(docs, path, public_tokenizers.PATTERN, ids_col=ids, decoded_col=decoded)
    same = F.col(decoded) == F.coalesce("text", F.lit("")).cast("binary")
    others = [c for c in docs.columns if c.lower() not in ("token_ids", "round_trip")]
    return out.select(*others, F.col(ids).alias("token_ids"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: Training and patience diff are beyond SQL; the tests hold each stage against a plain version of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's output is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
