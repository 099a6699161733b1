"""Raw documents and their metadata sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import base_name, decode_text, stem, suffix
from quire.operators.elements import content_id, infer_form
from quire.schema import DEFAULT_PROFILE, DOCUMENT_SUFFIXES, SIDECAR, SIDECAR_SUFFIX, UNFINISHED_SUFFIXES

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


TASKS = "spark.quire.source.tasks"


def spread(documents: DataFrame) -> DataFrame:
    """Documents over as many tasks as the session asks for under ``spark.quire.source.tasks``, else as the scan cuts them.

    For a table that is one file of one row group, which no scan setting can cut; it costs a shuffle of the text.
    """
    tasks = documents.sparkSession.conf.get(TASKS, None)
    return documents.repartition(int(tasks)) if tasks else documents


def is_candidate(name: Column) -> Column:
    """Names the intake accepts: a document suffix in any case, no sidecar, hidden or unfinished file."""
    lower = F.lower(name)
    unfinished = lower.endswith(SIDECAR_SUFFIX) | name.startswith(".")
    for ending in UNFINISHED_SUFFIXES:
        unfinished = unfinished | lower.endswith(ending)
    return F.lower(suffix(name)).isin(*DOCUMENT_SUFFIXES) & ~unfinished


def intake_filter(files: DataFrame) -> DataFrame:
    """Candidate documents that are not empty, from a listing with ``path`` and ``length``."""
    return files.where(is_candidate(base_name(F.col("path"))) & (F.col("length") > 0))


def as_documents(files: DataFrame) -> DataFrame:
    """File rows (path, modificationTime, length, content) to document rows with decoded text."""
    return files.select(
        "path",
        base_name(F.col("path")).alias("filename"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("modified"),
        content_id(F.col("content")).alias("content_id"),
        decode_text(F.col("content")).alias("content"),
    )


def scan_tasks(files: DataFrame) -> DataFrame:
    """A scan of many small files in a few tasks for each core, which stream through them.

    The scan counts every file as some MB and would plan a task for each handful of files.
    """
    spark = files.sparkSession
    return files.coalesce(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def raw_scan(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of a directory, one row per file. The file source never lists 0-byte files, as the intake never takes them."""
    files = spark.read.format("binaryFile").load(directory)
    return as_documents(scan_tasks(files.where(is_candidate(base_name(F.col("path"))))))


def sidecar_files(spark: SparkSession, directory: str) -> DataFrame:
    """Sidecar texts of a directory as (sidecar_name, body)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SIDECAR_SUFFIX}").load(directory)
    return files.select(base_name(F.col("path")).alias("sidecar_name"), decode_text(F.col("content")).alias("body"))


def resolve_sidecars(names: DataFrame, sidecars: DataFrame, required: tuple[str, ...] = ("doc_id", "source_filename")) -> DataFrame:
    """Best readable sidecar per file: ``name.meta.json`` before ``stem.meta.json``.

    ``names`` (filename) stays narrow, so only names and metadata are shuffled. A sidecar that does not parse, or lacks
    a required field, is passed over.
    """
    parsed = sidecars.select("sidecar_name", F.from_json("body", SIDECAR).alias("meta"))
    for field in required:
        parsed = parsed.where(F.col(f"meta.{field}").isNotNull())
    keys = F.array(F.col("filename"), stem(F.col("filename")))
    wanted = names.select("filename").distinct().select("filename", F.posexplode(keys).alias("choice", "key"))
    found = wanted.withColumn("sidecar_name", F.concat("key", F.lit(SIDECAR_SUFFIX))).join(parsed, "sidecar_name")
    return found.groupBy("filename").agg(F.min_by("meta", "choice").alias("meta"))


def sidecar_resolve(documents: DataFrame, sidecars: DataFrame | None) -> DataFrame:
    """Attach document columns: from the sidecar where one is readable, else derived from name and content.

    The document text is joined once, by file name. No broadcast is forced: Spark broadcasts the metadata only when its
    measured size is under its own limit.
    """
    name = F.col("filename")
    derived = {
        "doc_id": F.col("content_id"),
        "domain": F.lit(DEFAULT_PROFILE),
        "form_type": infer_form(name),
        "filing_date": F.lit(None).cast("date"),
        "company_name": F.lit(None).cast("string"),
        "ticker": F.lit(None).cast("string"),
    }
    if sidecars is None:
        columns = {**derived, "has_metadata": F.lit(False)}
        return documents.withColumns({**columns, "source_filename": name})
    resolved = resolve_sidecars(documents, sidecars)
    joined = documents.join(resolved, "filename", "left")
    # A sidecar without these fields is finance / MISC; it never falls back to the file name.
    defaults = {"domain": F.lit(DEFAULT_PROFILE), "form_type": F.lit("MISC")}
    present = F.col("meta").isNotNull()
    columns = {
        field: F.when(present, F.coalesce(F.col(f"meta.{field}"), defaults.get(field, F.lit(None)))).otherwise(value)
        for field, value in derived.items()
    }
    # Chunks carry the file's own name, whatever the sidecar says.
    return joined.withColumns({**columns, "has_metadata": present, "source_filename": name}).drop("meta")
