"""Bounds of lake files: the directions their vectors lie in, so that a search can leave files out.

For every block of up to BLOCK vectors of a file the folder ``_bounds`` of the lake holds a centre and the greatest angle
between the centre and a vector of the block. No vector of the block can be nearer to a query than that angle allows.
Folders with a leading underscore are no part of a lake scan or listing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.vectors import cosine_to
from quire.schema import PARTITIONS
from quire.sources.lake import lake_files, lake_scan
from quire.sources.scratch import path_exists

FOLDER = "_bounds"
BLOCK = 4096  # vectors
NAMED = 10_000  # files whose names may stand in a filter
SLACK = 1e-6  # for what rounding does to angles and scores
BLOCKS = "file string, n bigint, dim int, centre array<double>, reach double"


def file_of(path: Column) -> Column:
    """The path below the lake's root of ``_metadata.file_path``, which is written as a URL."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring_index(plain, "/", -1 - len(PARTITIONS))


def of_files(lake: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a lake scan that lie in the given files.

    Up to NAMED names go into a filter, by which Spark leaves the other files unopened. More are joined, and then all
    files are opened.
    """
    key = file_of(F.col("_metadata.file_path"))
    names = [row[0] for row in files.select("file").distinct().limit(NAMED + 1).collect()]
    if len(names) <= NAMED:
        return lake.where(key.isin(names))
    wanted = files.select(F.col("file").alias("_wanted")).distinct()
    return lake.join(wanted, key == F.col("_wanted"), "left_semi")


def _block(file: str, vectors: pa.Array) -> dict:
    """One row of the bounds; ``reach`` is null where a zero, odd-sized or non-finite vector leaves no bound."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    row = {"file": file, "n": len(vectors), "dim": None, "centre": None, "reach": None}
    if len(np.unique(lengths)) != 1 or not lengths[0]:
        return row
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norms = np.sqrt(np.einsum("ij,ij->i", values, values))
    row["dim"] = int(lengths[0])
    if not (np.isfinite(norms).all() and (norms > 0).all()):
        return row
    units = values / norms[:, None]
    centre = units.mean(axis=0)
    length = np.sqrt(centre @ centre)
    centre = centre / length if length > 1e-9 else units[0]  # opposite vectors have no mean direction
    row["centre"], row["reach"] = centre, float(np.arccos(np.clip(units @ centre, -1, 1)).max())
    return row


def measured(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Bounds of (file, embedding) rows. One pass without a shuffle; a task holds one block. Null vectors find nothing
    and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            vectors = pa.concat_arrays(held)
            return pa.RecordBatch.from_pylist([_block(file, vectors)], schema=schema)

        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            names = batch.column(0).to_pylist()
            at = 0
            while at < len(names):
                if size and (names[at] != file or size == block):
                    yield flush()
                    held, size = [], 0
                file = names[at]
                end = at + 1
                while end < len(names) and names[end] == file and size + end - at < block:
                    end += 1
                held.append(batch.column(1).slice(at, end - at))
                size += end - at
                at = end
        if size:
            yield flush()

    schema = pa.schema(
        [("file", pa.string()), ("n", pa.int64()), ("dim", pa.int32()), ("centre", pa.list_(pa.float64())), ("reach", pa.float64())]
    )
    return rows.where("embedding IS NOT NULL").select("file", "embedding").mapInArrow(run, BLOCKS)


def lake_bounds(spark: SparkSession, root: str) -> DataFrame:
    """The stored blocks; none where nothing was measured."""
    folder = f"{root.rstrip('/')}/{FOLDER}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], BLOCKS)
    return spark.read.schema(BLOCKS).parquet(folder)


def add_bounds(spark: SparkSession, root: str, block: int = BLOCK) -> None:
    """Measure the files that have no bounds yet; those of earlier writes are not read again.

    A failed run adds nothing and may be repeated. Files measured twice, by two runs at a time, do no harm.
    """
    fresh = lake_files(spark, root).select(F.col("relative_path").alias("file"))
    fresh = fresh.join(lake_bounds(spark, root).select("file").distinct(), "file", "left_anti")
    if fresh.isEmpty():
        return
    rows = of_files(lake_scan(spark, root), fresh).select(file_of(F.col("_metadata.file_path")).alias("file"), "embedding")
    measured(rows, block).write.mode("append").parquet(f"{root.rstrip('/')}/{FOLDER}")


def bounded_files(spark: SparkSession, root: str, query_vector: Sequence[float], lenient: bool = False) -> DataFrame:
    """(domain, year, month, day, file, bound): the greatest cosine a vector of the file can have with the query.

    Infinite where nothing is known: files without bounds, blocks with vectors that cannot be bounded or, unless
    ``lenient``, of another length, which a search has to refuse. Null where a file holds no vector of that length.
    """
    to_centre = cosine_to(query_vector, lenient=True)("centre")
    spare = F.greatest(F.lit(0.0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), to_centre))) - F.col("reach"))
    other = F.lit(None).cast("double") if lenient else F.lit(float("inf"))
    bound = (
        F.when(F.col("dim").isNotNull() & (F.col("dim") != len(query_vector)), other)
        .when(F.col("reach").isNull(), float("inf"))
        .otherwise(F.cos(spare) + SLACK)
    )
    blocks = lake_bounds(spark, root).select("file", bound.alias("bound"))
    known = blocks.groupBy("file").agg(F.max("bound").alias("bound"), F.lit(True).alias("known"))
    files = lake_files(spark, root).select(*PARTITIONS, F.col("relative_path").alias("file"))
    bound = F.when(F.col("known"), F.col("bound")).otherwise(float("inf"))
    return files.join(known, "file", "left").select(*PARTITIONS, "file", bound.alias("bound"))
