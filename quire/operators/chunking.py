"""Sections, chunks and their metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.sections import GENERAL, section_of
from quire.functions.text import strip, token_count, uuid_text

DOCUMENT_COLUMNS = ("doc_id", "domain", "source_filename", "form_type", "filing_date")


def with_sections(documents: DataFrame) -> DataFrame:
    """Give each entry of ``elements`` the latest section at or before it, ``General`` before the first.

    The array is cut at its headings and every run takes its heading's section: linear in the document, no shuffle.
    """
    marks = F.transform("elements", lambda e: section_of(e["text"]))
    starts = F.filter(
        F.transform(marks, lambda s, i: F.when(s.isNotNull(), F.struct(i.alias("at"), s.alias("section")))),
        lambda m: m.isNotNull(),
    )
    first = F.array(F.struct(F.lit(0).alias("at"), F.lit(GENERAL).alias("section")))
    runs = F.zip_with(
        F.concat(first, F.col("_starts")),
        F.concat(F.transform("_starts", lambda m: m["at"]), F.array(F.size("elements"))),
        lambda m, end: F.struct(m["section"].alias("section"), m["at"].alias("at"), (end - m["at"]).alias("n")),
    )
    placed = F.flatten(
        F.transform(
            runs,
            lambda run: F.transform(
                F.slice("elements", run["at"] + 1, run["n"]),
                lambda e: F.struct(
                    run["section"].alias("section"),
                    e["category"].alias("category"),
                    e["text"].alias("text"),
                    e["html"].alias("html"),
                ),
            ),
        )
    )
    return documents.withColumn("_starts", starts).withColumn("elements", placed).drop("_starts")


def explode_elements(documents: DataFrame) -> DataFrame:
    """One row per element with its position in the document."""
    others = [c for c in documents.columns if c != "elements"]
    # The outer form: the plain one makes Catalyst infer a size filter, which would parse every document twice.
    rows = documents.select(*others, F.posexplode_outer("elements").alias("position", "_e"))
    return rows.where(F.col("position").isNotNull()).select(*others, "position", "_e.*")


def section_cascade(
    elements: DataFrame, key: str = "doc_id", position: str = "position", text: str = "text", block: int = 4096
) -> DataFrame:
    """Section carry for elements that already are rows.

    Each document is cut into position blocks, so a document holding most of the table spreads over many tasks: the
    carry runs within blocks, and one row per block carries it across them.
    """
    marked = elements.withColumn("_block", F.floor(F.col(position) / block)).withColumn("_mark", section_of(F.col(text)))
    inside = Window.partitionBy(key, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy(key, "_block")
        .agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(position))).alias("_last"))
        .select(key, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    )
    return (
        marked.withColumn("_here", F.last("_mark", ignorenulls=True).over(inside))
        .join(carried, [key, "_block"])
        .withColumn("section", F.coalesce("_here", "_carried", F.lit(GENERAL)))
        .drop("_block", "_mark", "_here", "_carried")
    )


def chunk_key(doc_id: Column, position: Column) -> Column:
    return uuid_text(F.concat_ws(":", doc_id, position.cast("string")))


def assemble_chunks(elements: DataFrame) -> DataFrame:
    """Element rows to chunk rows: tables keep their markup verbatim, prose is stripped and blanks dropped."""
    is_table = (F.col("category") == "Table") | F.col("html").isNotNull()
    table_html = F.coalesce("html", F.when(F.lower("text").contains("<table"), F.col("text")))
    return (
        elements.withColumn("is_table", is_table)
        .withColumn("table_html", F.when(is_table, table_html))
        .withColumn("text", F.when(is_table, F.coalesce("table_html", "text")).otherwise(strip(F.col("text"))))
        .where(F.col("is_table") | (F.col("text") != ""))
        .withColumn("token_count", token_count(F.col("text")))
        .withColumn("element_type", F.when(F.col("is_table"), "Table").otherwise(F.col("category")))
        .withColumn("chunk_id", chunk_key(F.col("doc_id"), F.col("position")))
        .drop("html")
    )


METADATA_FIELDS = (
    "element_type",
    "category",
    "table_html",
    "token_count",
    "parent_chunk_id",
    "sub_chunk_index",
    "total_sub_chunks",
    "is_split",
    "table_id",
    "is_table_fragment",
    "page_number",
    "source_path",
)


def pack_metadata(chunks: DataFrame, fields: Sequence[str] = METADATA_FIELDS) -> DataFrame:
    """Fold the columns in ``fields`` into ``metadata_json``; absent columns and nulls are left out."""
    present = [f for f in fields if f in chunks.columns]
    packed = F.to_json(F.struct(*present)) if present else F.lit("{}")
    return chunks.withColumn("metadata_json", packed).drop(*present)


def doc_metrics(chunks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Chunks, tokens and tables per document."""
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum("token_count").alias("token_total"),
        F.count_if("is_table").alias("table_count"),
    )
