"""What a reader sees of search hits and of the lake."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.display import score_band, score_percent
from quire.functions.text import strip, truncate


def parse_metadata(metadata: Column) -> Column:
    """JSON object text to a map; unparseable text is kept under ``raw``, empty text gives an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.coalesce(metadata, F.lit("")) == "", empty).otherwise(
        F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map(F.lit("raw"), metadata))
    )


def excerpt(text: Column, size: int) -> Column:
    return strip(truncate(text, size))


def citations(hits: DataFrame) -> DataFrame:
    """Source, section, identifier, 4-decimal score and a 280-character excerpt per hit."""
    text = F.col("text")
    ending = F.when(F.length(text) > 280, "...").otherwise("")
    return hits.select(
        "source_filename",
        "section",
        "chunk_id",
        F.round("similarity_score", 4).alias("similarity_score"),
        F.concat(excerpt(text, 280), ending).alias("excerpt"),
    )


def no_hits_text(domain: str) -> str:
    # Fixed value: the answer when nothing was found.
    return (
        f"No relevant context chunks were located in the lakehouse for domain '{domain}' "
        "matching the query and active metadata filters."
    )


def grounded_digest(hits: DataFrame, requests: DataFrame, domain: str = "finance") -> DataFrame:
    """One text per question: hit count, first three sources, three scored bullets, primary source.

    ``hits`` holds the ranked hits of a search (query_id, rank, ...), so at most 100 rows per question;
    ``requests`` (query_id) names all questions, and one without hits gets the fixed sentence.
    """
    line = F.struct(
        F.col("rank"),
        F.col("source_filename").alias("source"),
        F.col("section"),
        F.concat(
            F.lit("• ["),
            F.col("section"),
            F.format_string(" // Score: %.4f]: ", F.col("similarity_score")),
            excerpt(F.col("text"), 200),
            F.lit("..."),
        ).alias("bullet"),
    )
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    sources = F.slice(F.array_distinct(F.transform("lines", lambda x: x["source"])), 1, 3)
    bullets = F.slice(F.transform("lines", lambda x: x["bullet"]), 1, 3)
    first = F.col("lines")[0]
    # The wording of the digest.
    answer = F.concat(
        F.lit("Grounded analysis based on "),
        F.size("lines").cast("string"),
        F.lit(" retrieved context chunks from "),
        F.array_join(sources, ", "),
        F.lit(":\n\n"),
        F.array_join(bullets, "\n"),
        F.lit("\n\nPrimary attribution grounded in "),
        first["source"],
        F.lit(" ("),
        first["section"],
        F.lit(")."),
    )
    return (
        requests.select("query_id")
        .join(ranked, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("hits"),
            F.when(F.col("lines").isNull(), F.lit(no_hits_text(domain))).otherwise(answer).alias("answer"),
        )
    )


def with_score_band(hits: DataFrame) -> DataFrame:
    score = F.col("similarity_score")
    return hits.withColumns({"band": score_band(score), "percent": score_percent(score)})


def result_table(hits: DataFrame) -> DataFrame:
    """Rank, score text, source, section, kind and a one-line excerpt of the at most 100 hits of one search."""
    order = Window.orderBy(F.desc("similarity_score"), "chunk_id")
    return hits.select(
        F.concat(F.lit("#"), F.row_number().over(order).cast("string")).alias("rank"),
        F.format_string("%.4f", F.col("similarity_score")).alias("similarity"),
        "source_filename",
        "section",
        F.when(F.col("is_table"), "Table").otherwise("Prose").alias("kind"),
        F.concat(F.translate(truncate(F.col("text"), 150), "\n", " "), F.lit("...")).alias("excerpt"),
    )


def tabular_chunks(lake: DataFrame, k: int = 10) -> DataFrame:
    rows = lake.where("is_table").select(
        "chunk_id", "source_filename", "section", F.length("text").cast("bigint").alias("char_length"), "text"
    )
    return rows.orderBy("chunk_id").limit(k)


def count_by_domain(lake: DataFrame) -> DataFrame:
    return lake.groupBy("domain").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("source_filename").alias("file_count")
    )


def distribution(lake: DataFrame, keys: Sequence[str] = ("domain", "year", "form_type")) -> DataFrame:
    """Chunk counts by the given keys, latest year first."""
    counts = lake.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("year"), *[k for k in keys if k != "year"])


def describe_lake(spark: SparkSession, lake: DataFrame) -> DataFrame:
    """Column names and types as rows; reads no data."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(lake.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, column_type string")


