"""Ingestion queue: items, filters, metrics, retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.display import format_utc
from quire.functions.text import stem, strip, suffix
from quire.schema import DEFAULT_PROFILE, SIDECAR_SUFFIX

ITEM_META = "ticker string, form_type string, company_name string, domain string"


def sidecars_by_file(files: DataFrame, sidecars: DataFrame, schema: str = ITEM_META) -> DataFrame:
    """Readable sidecar per (status, filename) within the same folder, the full name before the stem."""
    parsed = sidecars.select("status", "sidecar_name", F.from_json("body", schema).alias("meta"), "body").where(
        F.try_parse_json("body").isNotNull() & F.col("meta").isNotNull()
    )
    keys = F.array(F.col("filename"), stem(F.col("filename")))
    wanted = files.select("status", "filename").select("status", "filename", F.posexplode(keys).alias("choice", "key"))
    found = wanted.withColumn("sidecar_name", F.concat("key", F.lit(SIDECAR_SUFFIX))).join(
        parsed, ["status", "sidecar_name"]
    )
    return found.groupBy("status", "filename").agg(F.min_by(F.struct("meta", "body"), "choice").alias("sidecar"))


def queue_items(files: DataFrame, sidecars: DataFrame, errors: DataFrame) -> DataFrame:
    """Listing plus sidecar columns, and the error of failed files."""
    failed = errors.select("filename", F.lit("FAILED").alias("status"), "error_type", "error_message")
    meta = F.col("sidecar.meta")
    return (
        files.join(sidecars_by_file(files, sidecars), ["status", "filename"], "left")
        .join(failed, ["status", "filename"], "left")
        .select(
            "filename",
            "status",
            "file_size_bytes",
            "mtime",
            meta["ticker"].alias("ticker"),
            meta["form_type"].alias("form_type"),
            meta["company_name"].alias("company_name"),
            F.coalesce(meta["domain"], F.lit(DEFAULT_PROFILE)).alias("domain"),
            "error_type",
            "error_message",
            F.col("sidecar").isNotNull().alias("has_metadata"),
        )
    )


SEARCHED = ("filename", "ticker", "form_type", "company_name")


def queue_filter(items: DataFrame, status: str | None = None, query: str | None = None) -> DataFrame:
    """Status equality (ALL means any) and a case-insensitive substring over name, ticker, form and company."""
    if status and status.upper() != "ALL":
        items = items.where(F.col("status") == status.upper())
    if query:
        needle = query.strip().lower()
        fields = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in SEARCHED if c in items.columns]
        items = items.where(reduce(Column.__or__, fields))
    return items


def queue_sort(items: DataFrame) -> DataFrame:
    """Newest first, ties by name."""
    return items.orderBy(F.desc("mtime"), "filename")


def queue_metrics(items: DataFrame) -> DataFrame:
    """One row: counts per status, processed bytes, failure percentage of settled files, latest processed time."""
    processed = F.col("status") == "PROCESSED"
    counts = items.agg(
        F.count_if(F.col("status") == "PENDING").alias("incoming_count"),
        F.count_if(processed).alias("processed_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_count"),
        F.coalesce(F.sum(F.when(processed, F.col("file_size_bytes"))), F.lit(0)).alias("total_processed_bytes"),
        F.max(F.when(processed, F.col("mtime"))).alias("latest"),
    )
    settled = F.col("processed_count") + F.col("failed_count")
    rate = F.round(F.col("failed_count") * 100.0 / F.nullif(settled, F.lit(0)), 2)
    return counts.select(
        "incoming_count",
        "processed_count",
        "failed_count",
        "total_processed_bytes",
        F.coalesce(rate, F.lit(0.0)).alias("failure_rate_pct"),
        F.concat(format_utc(F.col("latest")), F.lit(" UTC")).alias("latest_ingest_time"),
    )


# Folders are searched in this order after the hinted one.
LOOKUP_ORDER = ("PROCESSED", "PENDING", "FAILED")


def metadata_lookup(requests: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecar of each requested file (filename, status hint or null), the hinted folder first.

    Empty objects count as absent. Each request keeps the best candidate by an aggregate, not a sort.
    """
    keys = F.array(F.col("filename"), stem(F.col("filename")))
    wanted = requests.select(
        "filename", F.upper("status").alias("hint"), F.posexplode(keys).alias("choice", "key")
    ).withColumn("sidecar_name", F.concat("key", F.lit(SIDECAR_SUFFIX)))
    readable = sidecars.where(F.from_json("body", "map<string,string>").isNotNull())
    folder = F.array_position(F.array(*[F.lit(s) for s in LOOKUP_ORDER]), F.col("status"))
    order = F.when(F.col("status") == F.col("hint"), 0).otherwise(folder)
    # Within a folder the first readable sidecar decides, even if it is an empty object.
    per_folder = (
        wanted.join(readable, "sidecar_name")
        .groupBy("filename", "hint", "status")
        .agg(F.min_by("body", "choice").alias("body"))
        .where(F.size(F.from_json("body", "map<string,string>")) > 0)
    )
    best = per_folder.groupBy("filename", "hint").agg(
        F.min_by(F.struct(F.col("status").alias("found_in"), F.col("body")), order).alias("best")
    )
    asked = requests.select("filename", F.upper("status").alias("hint"))
    same = (asked["filename"] == best["filename"]) & asked["hint"].eqNullSafe(best["hint"])
    return asked.join(best, same, "left").select(
        asked["filename"], asked["hint"], F.col("best.found_in").alias("found_in"), F.col("best.body").alias("body")
    )


def requeue(items: DataFrame, names: DataFrame) -> DataFrame:
    """Next state of the queue: the named failed files are pending again with a higher attempt and no error.

    The attempt becomes part of the file's new path, since a file source never offers the same path twice.
    """
    attempt = F.col("attempt") if "attempt" in items.columns else F.lit(1)
    wanted = names.select("filename").distinct().withColumn("_again", F.lit(True))
    again = F.coalesce("_again", F.lit(False)) & (F.col("status") == "FAILED")
    joined = items.withColumn("attempt", attempt).join(wanted, "filename", "left")
    cleared = {c: F.when(~again, F.col(c)) for c in ("error_type", "error_message") if c in items.columns}
    return joined.withColumns(
        {
            **cleared,
            "status": F.when(again, "PENDING").otherwise(F.col("status")),
            "attempt": F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")),
        }
    ).drop("_again")


def unique_dest(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """Destination names without collisions for moves (path, filename) into a folder listing (filename).

    The first path of a name keeps it when it is free; any other gets a suffix from the hash of its path, and of its
    content and attempt where the moves tell them, so a path that collides again gets another name. A per-name
    aggregate replaces numbering, so one very common name is no hot group.
    """
    first = moves.groupBy("filename").agg(F.min("path").alias("_first"))
    taken = existing.select("filename").distinct().withColumn("_taken", F.lit(True))
    names = first.join(taken, "filename", "left")
    keep = F.col("_taken").isNull() & (F.col("path") == F.col("_first"))
    told = [F.col(c).cast("string") for c in ("path", "content_id", "attempt") if c in moves.columns]
    tag = F.substring(F.sha2(F.concat_ws("\n", *told), 256), 1, 16)
    name = F.col("filename")
    return (
        moves.join(names, "filename")
        .withColumn("dest", F.when(keep, name).otherwise(F.concat(stem(name), F.lit("_"), tag, suffix(name))))
        .drop("_first", "_taken")
    )


def dispatch_once(pending: DataFrame, in_flight: DataFrame, key: str = "path") -> DataFrame:
    """Pending files that are not being processed already."""
    return pending.join(in_flight.select(key), key, "left_anti").distinct()
