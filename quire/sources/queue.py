"""Listings of the ingestion folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import base_name, decode_text
from quire.schema import ERROR_SUFFIX, UNLISTED_SUFFIXES
from quire.sources.documents import scan_tasks, sidecar_files
from quire.sources.scratch import path_exists

STATUSES = ("PENDING", "PROCESSED", "FAILED")


def is_listed(name: Column) -> Column:
    """Not hidden, and neither sidecar, error log nor unfinished download."""
    return ~reduce(Column.__or__, [name.endswith(s) for s in UNLISTED_SUFFIXES], name.startswith("."))


def _listing(spark: SparkSession, directory: str, status: str) -> DataFrame:
    files = scan_tasks(spark.read.format("binaryFile").load(directory).select("path", "length", "modificationTime"))
    return files.select(
        base_name(F.col("path")).alias("filename"),
        F.lit(status).alias("status"),
        F.col("length").alias("file_size_bytes"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"),
    )


def queue_files(spark: SparkSession, incoming: str, processed: str, failed: str) -> DataFrame:
    """Files of the three folders with their status; folders that do not exist are skipped, contents are not read."""
    folders = dict(zip(STATUSES, (incoming, processed, failed)))
    present = [_listing(spark, d, s) for s, d in folders.items() if path_exists(spark, d)]
    if not present:
        return spark.createDataFrame([], "filename string, status string, file_size_bytes bigint, mtime double")
    return reduce(DataFrame.unionByName, present).where(is_listed(F.col("filename")))


def queue_sidecars(spark: SparkSession, incoming: str, processed: str, failed: str) -> DataFrame:
    """Sidecars of the three folders as (status, sidecar_name, body)."""
    folders = dict(zip(STATUSES, (incoming, processed, failed)))
    found = [sidecar_files(spark, d).withColumn("status", F.lit(s)) for s, d in folders.items() if path_exists(spark, d)]
    if not found:
        return spark.createDataFrame([], "sidecar_name string, body string, status string")
    return reduce(DataFrame.unionByName, found)


def error_records(spark: SparkSession, failed: str) -> DataFrame:
    """Dead-letter files as (filename, error_type, error_message); none where the folder does not exist."""
    if not path_exists(spark, failed):
        return spark.createDataFrame([], "filename string, error_type string, error_message string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ERROR_SUFFIX}").load(failed)
    name = base_name(F.col("path"))
    record = F.from_json(decode_text(F.col("content")), "error_type string, error_message string")
    return files.select(
        F.substr(name, F.lit(1), F.length(name) - len(ERROR_SUFFIX)).alias("filename"), record.alias("r")
    ).select("filename", "r.error_type", "r.error_message")
