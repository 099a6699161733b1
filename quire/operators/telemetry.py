"""Lake inventory figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.schema import PARTITIONS


def lake_stats(files: DataFrame) -> DataFrame:
    """File count, bytes, sorted domains and sorted folders of a ``lake_files`` listing, as one row.

    The listing is first reduced to one row per folder, so the arrays hold folders, never files.
    """
    folder = F.regexp_extract("relative_path", r"^(.*)/[^/]*\z", 1)
    folders = files.groupBy(folder.alias("folder"), "domain").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")
    )
    return folders.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_parquet_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size_bytes"),
        F.array_sort(F.collect_set(F.when(F.col("domain") != "unknown", F.col("domain")))).alias("domains"),
        F.array_sort(F.collect_set(F.when(F.col("folder") != "", F.col("folder")))).alias("partitions"),
    )


def lake_kpis(files: DataFrame) -> DataFrame:
    """Files, bytes, known domains and distinct path values of a listing, as one row."""
    known = F.when(F.col("domain") != "unknown", F.col("domain"))
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.count_distinct(known).alias("domains"),
        F.count_distinct(F.concat_ws("/", *PARTITIONS)).alias("partitions"),
    )
