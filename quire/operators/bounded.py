"""Vector search over a stored lake that leaves files unread whose bounds rule them out."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import truncate
from quire.operators.retrieval import metadata_filter, search_stored, top_k, with_cosine
from quire.sources.bounds import bounded_files, of_files
from quire.sources.lake import date_bounds, lake_scan, path_name
from quire.sources.scratch import path_exists

SEEDS = 16  # files read first, to learn what a hit must score


def files_to_read(
    spark: SparkSession,
    root: str,
    query_vector: Sequence[float],
    *,
    domain: str | None = "finance",
    form_type: str | None = None,
    start_date: date | None = None,
    end_date: date | None = None,
    is_table_only: bool = False,
    k: int = 5,
    similarity_threshold: float = 0.0,
    lenient: bool = False,
    seeds: int = SEEDS,
) -> DataFrame:
    """(domain, year, month, day, file, bound, read) for the files of the folders a search may look into.

    The files of the greatest bounds are opened first, at most ``seeds``. A file has to be read if its bound reaches the
    k-th score found there and the threshold; in any other no row can be among the best k. Ties are read.
    """
    files = bounded_files(spark, root, query_vector, lenient)
    if domain and domain.strip():
        files = files.where(F.col("domain") == path_name(spark, domain.strip().lower()))
    if start_date or end_date:
        files = files.withColumns({c: F.col(c).cast("int") for c in ("year", "month", "day")})
        files = files.where(date_bounds(start_date, end_date))
    first = files.where(F.col("bound") >= similarity_threshold).orderBy(F.desc("bound"), "file").limit(max(1, seeds))
    rows = of_files(lake_scan(spark, root, domain), first)
    rows = metadata_filter(rows, domain, form_type, start_date, end_date, is_table_only)
    scored = with_cosine(rows.select("chunk_id", "embedding"), query_vector, lenient).drop("embedding")
    best = top_k(scored.where("similarity_score IS NOT NULL"), k)
    found, least = best.agg(F.count("*"), F.min("similarity_score")).first()
    floor = similarity_threshold
    if found == max(1, k):  # NaN ranks first, so k of them leave only files that may hold more
        floor = math.inf if math.isnan(least) else max(floor, least)
    return files.withColumn("read", F.coalesce(F.col("bound") >= floor, F.lit(False)))


def search_bounded(
    spark: SparkSession, root: str, query_vector: Sequence[float], *, seeds: int = SEEDS, **options
) -> DataFrame:
    """``search_stored`` with the same options and hits, over the files that the bounds do not rule out.

    Files written since the bounds were measured are read. A query without a direction, empty, zero or non-finite,
    reads everything.
    """
    lake = lake_scan(spark, root, options.get("domain", "finance"))
    length = math.sqrt(sum(float(v) * float(v) for v in query_vector))
    if not path_exists(spark, root) or not 0 < length < math.inf:
        return search_stored(lake, query_vector, **options)
    files = files_to_read(spark, root, query_vector, seeds=seeds, **options)
    return search_stored(of_files(lake, files.where("read")), query_vector, **options)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select(
        "chunk_id",
        "source_filename",
        "section",
        "is_table",
        F.round("similarity_score", 4).alias("cosine_similarity"),
        truncate(F.col("text"), 140).alias("excerpt"),
    )


def prompt_search_bounded(spark: SparkSession, root: str, prompt_vector: Sequence[float], k: int = 10) -> DataFrame:
    """``prompt_search`` over a stored lake: text is read for the winners, vectors where the bounds allow a winner."""
    return _shown(search_bounded(spark, root, prompt_vector, domain=None, k=k, similarity_threshold=-math.inf))


def search_by_example_bounded(spark: SparkSession, root: str, phrases: Sequence[str], k: int = 10) -> DataFrame:
    """``search_by_example`` over a stored lake: texts are read once to find the example, and for the winners."""
    lake = lake_scan(spark, root)
    holds: Column = reduce(Column.__or__, [F.lower("text").contains(p.lower()) for p in phrases])
    example = lake.where(holds).agg(F.min_by("embedding", "chunk_id").alias("vector")).first()["vector"]
    return prompt_search_bounded(spark, root, example or [], k)
