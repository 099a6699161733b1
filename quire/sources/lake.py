"""The chunk lake: Parquet under domain / year / month / day folders."""

from __future__ import annotations

from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.display import format_bytes, utc_text
from quire.functions.text import base_name, strip
from quire.schema import LAKE, PARTITIONS
from quire.sources.scratch import path_exists


def lake_scan(spark: SparkSession, root: str, domain: str | None = None) -> DataFrame:
    """Lake rows with their path columns; a missing lake or domain is empty, not an error.

    Of a domain only its own folder is listed.
    """
    key = (domain or "").strip().lower()
    folder = f"{root.rstrip('/')}/domain={path_name(spark, key)}" if key else root
    if not path_exists(spark, folder):
        return spark.createDataFrame([], LAKE)
    return spark.read.schema(LAKE).option("basePath", root).parquet(folder)


def path_name(spark: SparkSession, value: str) -> str:
    """A value as Spark writes it into the name of a partition folder."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def normal_domain(domain: Column) -> Column:
    key = F.lower(strip(domain))
    return F.when(key == "", "general").otherwise(key)


def with_partitions(chunks: DataFrame, ingest_date: date | None = None) -> DataFrame:
    """Add the path columns; a chunk without a filing date goes under ``ingest_date`` (today in UTC by default)."""
    fallback = F.lit(ingest_date) if ingest_date else F.to_date(F.to_utc_timestamp(F.now(), F.current_timezone()))
    day = F.coalesce("filing_date", fallback)
    return chunks.withColumns(
        {
            "domain": normal_domain(F.col("domain")),
            "year": F.date_format(day, "yyyy"),
            "month": F.date_format(day, "MM"),
            "day": F.date_format(day, "dd"),
        }
    )


def balance(chunks: DataFrame) -> DataFrame:
    """Bring each path's rows together for writing.

    A rebalance, not a plain repartition: adaptive execution merges small paths into one task and splits a path that
    holds much of the data over many, so one busy day neither fills one task nor one giant file.
    """
    return chunks.hint("rebalance", *PARTITIONS)


class MissingEmbeddings(ValueError):
    """Chunks offered to the lake have no vector."""


def missing_embeddings(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks lack a vector, and up to three of their identifiers."""
    missing = chunks.where(F.col("embedding").isNull() | (F.size("embedding") == 0)).select("chunk_id")
    # Three identifiers are picked by a distributed top-3, never by collecting every one.
    sample = missing.orderBy("chunk_id").limit(3).agg(F.array_sort(F.collect_list("chunk_id")).alias("examples"))
    return missing.agg(F.count(F.lit(1)).alias("missing")).withColumn(
        "examples", F.coalesce(sample.scalar(), F.array().cast("array<string>"))
    )


def embedding_check(chunks: DataFrame) -> None:
    """Raise when any chunk lacks a vector."""
    found = missing_embeddings(chunks).first()
    if found["missing"]:
        raise MissingEmbeddings(
            f"lake write refused: {found['missing']} chunks are missing vector embeddings, {found['examples']} among them"
        )


_NO_VECTOR = "QUIRE_MISSING_EMBEDDING"


def write_lake(
    chunks: DataFrame, root: str, ingest_date: date | None = None, balanced: bool = False
) -> None:
    """Append chunks to the lake; the whole batch is refused if any vector is missing.

    The test for missing vectors rides in the write itself: a failed write commits nothing, and only then is the
    detailed check run. Pass ``balanced`` when the rows are partitioned for writing already.
    """
    rows = chunks if balanced else balance(with_partitions(chunks, ingest_date))
    vector = F.when(F.size("embedding") > 0, F.col("embedding")).otherwise(F.raise_error(F.lit(_NO_VECTOR)))
    guarded = rows.withColumn("embedding", vector.cast("array<float>")).select(*LAKE.fieldNames())
    try:
        guarded.write.mode("append").partitionBy(*PARTITIONS).option("compression", "snappy").parquet(root)
    except PySparkException as error:
        if _NO_VECTOR in str(error):
            embedding_check(chunks)
        raise


def date_bounds(start: date | None, end: date | None) -> Column | None:
    """Path-date predicate that lets a filing-date range skip folders."""
    path_date = F.make_date("year", "month", "day")
    bounds = [path_date >= F.lit(start)] if start else []
    bounds += [path_date <= F.lit(end)] if end else []
    return bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1] if bounds else None


def lake_files(spark: SparkSession, root: str) -> DataFrame:
    """Lake files with their path values, size and modification time; file contents are not read. A missing lake has none."""
    if path_exists(spark, root):
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(root)
            .select("path", "length", "modificationTime")
        )
    else:
        files = spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")

    def segment(name: str) -> Column:
        value = F.regexp_extract("relative_path", rf"(?:^|/){name}=([^/]*)/", 1)
        return F.when(value == "", "unknown").otherwise(value).alias(name)

    marker = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.substring_index("path", f"/{marker}/", -1)
    return (
        files.withColumn("relative_path", relative)
        .select(
            *[segment(p) for p in PARTITIONS],
            base_name(F.col("path")).alias("filename"),
            "relative_path",
            F.col("length").alias("size_bytes"),
            format_bytes(F.col("length")).alias("size_formatted"),
            utc_text(F.col("modificationTime")).alias("modified"),
        )
    )
