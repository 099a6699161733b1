"""Compare retrieved chunks with a truth set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_eval(
    hits: DataFrame, truth: DataFrame, least_precision: float = 0.5, least_recall: float = 0.5
) -> DataFrame:
    """Precision and recall per query, and whether both thresholds are met.

    ``hits`` and ``truth`` hold (query_id, chunk_id). Queries without hits or without truth score 0.
    """
    keys = ["query_id", "chunk_id"]
    marked = (
        hits.select(*keys, F.lit(1).alias("hit"))
        .distinct()
        .join(truth.select(*keys, F.lit(1).alias("relevant")).distinct(), keys, "full")
    )
    counts = marked.groupBy("query_id").agg(
        F.count("hit").alias("retrieved"),
        F.count("relevant").alias("relevant"),
        F.count(F.col("hit") + F.col("relevant")).alias("matched"),
    )
    return _ratios(counts, least_precision, least_recall)


def class_eval(
    hits: DataFrame,
    chunk_classes: DataFrame,
    query_classes: DataFrame,
    least_precision: float = 0.5,
    least_recall: float = 0.5,
) -> DataFrame:
    """``retrieval_eval`` where the truth is a rule: a chunk is relevant to the queries of its class.

    ``chunk_classes`` holds (chunk_id, class) once each, ``query_classes`` (query_id, class) once each; null is no class.
    The number of relevant chunks comes from the sizes of the classes and the matched ones from the hits alone, so no
    pair of query and relevant chunk is ever listed.
    """
    sizes = chunk_classes.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    relevant = query_classes.join(sizes, "class").groupBy("query_id").agg(F.sum("size").alias("relevant"))
    found = hits.select("query_id", "chunk_id").distinct()
    held = found.join(chunk_classes, "chunk_id", "left")
    own = query_classes.select("query_id", "class", F.lit(1).alias("matched"))
    matched = held.join(own, ["query_id", "class"], "left").groupBy("query_id").agg(
        F.count_distinct("chunk_id").alias("retrieved"), F.count("matched").alias("matched")
    )
    zero = F.lit(0).cast("bigint")
    counts = matched.join(relevant, "query_id", "full").select(
        "query_id", *[F.coalesce(c, zero).alias(c) for c in ("retrieved", "relevant", "matched")]
    )
    return _ratios(counts, least_precision, least_recall)


def _ratios(counts: DataFrame, least_precision: float, least_recall: float) -> DataFrame:
    ratios = counts.withColumns(
        {
            "precision": F.coalesce(F.col("matched") / F.nullif("retrieved", F.lit(0)), F.lit(0.0)),
            "recall": F.coalesce(F.col("matched") / F.nullif("relevant", F.lit(0)), F.lit(0.0)),
        }
    )
    passed = (F.col("precision") >= least_precision) & (F.col("recall") >= least_recall)
    return ratios.withColumn("passed", passed)


def evaluation_summary(ratios: DataFrame, least_precision: float = 0.5, least_recall: float = 0.5) -> DataFrame:
    """One row for a query set's ``retrieval_eval``: queries, mean precision and recall, and whether both means reach
    their thresholds. No queries do not pass."""
    means = ratios.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("mean_precision"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"),
    )
    reached = (F.col("mean_precision") >= least_precision) & (F.col("mean_recall") >= least_recall)
    return means.withColumn("passed", (F.col("queries") > 0) & reached)
