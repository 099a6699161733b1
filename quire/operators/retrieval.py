"""Exact vector search over the lake."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import truncate
from quire.functions.vectors import cosine_scores, cosine_to
from quire.schema import PARTITIONS
from quire.sources.lake import date_bounds
from quire.sources.scratch import scratch_dir

HIT_COLUMNS = ("chunk_id", "source_filename", "section", "text", "is_table", "form_type", "filing_date", "metadata_json")


def metadata_filter(
    lake: DataFrame,
    domain: str | None = None,
    form_type: str | None = None,
    start_date: date | None = None,
    end_date: date | None = None,
    is_table_only: bool = False,
) -> DataFrame:
    """Rows matching every given condition; date bounds are inclusive.

    On a lake with path columns the date range also becomes a partition predicate.
    """
    conditions: list[Column] = []
    if domain:
        conditions.append(F.col("domain") == domain.strip().lower())
    if form_type:
        conditions.append(F.col("form_type") == form_type)
    if start_date:
        conditions.append(F.col("filing_date") >= F.lit(start_date))
    if end_date:
        conditions.append(F.col("filing_date") <= F.lit(end_date))
    if {"year", "month", "day"} <= set(lake.columns) and (start_date or end_date):
        conditions.append(date_bounds(start_date, end_date))
    if is_table_only:
        conditions.append(F.col("is_table"))
    return reduce(DataFrame.where, conditions, lake)


def with_cosine(lake: DataFrame, query_vector: Sequence[float], lenient: bool = False) -> DataFrame:
    """Add ``similarity_score`` in double precision: NaN for a zero vector, an error for another length."""
    return lake.withColumn("similarity_score", cosine_to(query_vector, lenient)("embedding"))


def top_k(scored: DataFrame, k: int, score: str = "similarity_score") -> DataFrame:
    """Best ``k`` rows, ties by ``chunk_id``: each task keeps k rows and the driver merges them."""
    return scored.orderBy(F.desc(score), "chunk_id").limit(max(1, k))


def threshold(ranked: DataFrame, least: float, score: str = "similarity_score") -> DataFrame:
    """Rows scoring at least ``least``. Apply after ``top_k``: the survivors are a prefix of the ranking."""
    return ranked.where(F.col(score) >= least)


def search(
    lake: DataFrame,
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
) -> DataFrame:
    """Filter on metadata, score what is left, keep the best k above the threshold. ``domain=None`` means all."""
    rows = metadata_filter(lake, domain, form_type, start_date, end_date, is_table_only)
    if not len(query_vector):
        return rows.select(*HIT_COLUMNS, F.lit(0.0).alias("similarity_score")).limit(0)
    scored = with_cosine(rows.select(*HIT_COLUMNS, "embedding"), query_vector, lenient).drop("embedding")
    return threshold(top_k(scored, k), similarity_threshold)


def search_stored(
    lake: DataFrame,
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
) -> DataFrame:
    """``search`` over a lake scan that reads text for the winners only.

    The ranking pass reads vectors and filter columns. The k winners, known by file and row, are then joined back on
    their folders, which Spark prunes at run time to at most k of them. Rows come out in ranking order.
    """
    if not len(query_vector):
        return search(lake, query_vector)
    place = {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
    try:
        placed = lake.withColumns(place)
    except AnalysisException:  # a missing lake has no files to point into
        return search(lake.limit(0), [])
    rows = metadata_filter(placed, domain, form_type, start_date, end_date, is_table_only)
    keys = [*PARTITIONS, *place]
    scored = with_cosine(rows.select(*keys, "chunk_id", "embedding"), query_vector, lenient).drop("embedding")
    best = threshold(top_k(scored, k), similarity_threshold).drop("chunk_id")
    texts = placed.select(*HIT_COLUMNS, *keys)
    return (
        texts.join(best, keys)
        .select(*HIT_COLUMNS, "similarity_score")
        .orderBy(F.desc("similarity_score"), "chunk_id")
        .limit(max(1, k))
    )


def search_by_example(lake: DataFrame, phrases: Sequence[str], k: int = 10) -> DataFrame:
    """Chunks nearest to the first chunk that contains any of the phrases; no rows when none does.

    The example is one vector found by an aggregate and then fixed in the scoring function, so no join is planned.
    """
    columns = ("chunk_id", "source_filename", "section", "is_table")
    holds = reduce(Column.__or__, [F.lower("text").contains(p.lower()) for p in phrases])
    example = lake.where(holds).agg(F.min_by("embedding", "chunk_id").alias("vector")).first()["vector"]
    rows = lake.select(*columns, "text", "embedding")
    if example is None:
        rows, example = rows.limit(0), [0.0]
    scored = rows.withColumn("cosine_similarity", cosine_to(example)("embedding"))
    excerpt = truncate(F.col("text"), 140).alias("excerpt")
    return top_k(scored.drop("embedding"), k, "cosine_similarity").select(*columns, "cosine_similarity", excerpt)


def prompt_search(lake: DataFrame, prompt_vector: Sequence[float], k: int = 10) -> DataFrame:
    """Unfiltered top k for a prompt's vector, as the console shows it."""
    columns = ["chunk_id", "source_filename", "section", "is_table"]
    ranked = top_k(with_cosine(lake.select(*columns, "text", "embedding"), prompt_vector).drop("embedding"), k)
    return ranked.select(
        *columns,
        F.round("similarity_score", 4).alias("cosine_similarity"),
        truncate(F.col("text"), 140).alias("excerpt"),
    )


QUERY_BLOCK = 1024  # queries scored at once
TILE = 1024  # chunks scored at once
HELD = 64  # blocks of queries whose best hits a task keeps in memory


def _packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(dim, keys, marks, vectors): up to so many vectors of one length a row, as bytes. Null vectors are left out."""
    kind, element = dict(rows.dtypes)[key], "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(2)), -1).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths >= 0]).tolist():
                own = np.flatnonzero(lengths == dim)
                for at in range(0, len(own), size):
                    keys, marks, vectors = batch.take(pa.array(own[at : at + size])).columns
                    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(element)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": pa.array([dim], pa.int32()),
                            "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                            "marks": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), marks),
                            "vectors": pa.array([values.tobytes()]),
                        }
                    )

    marked = rows.select(key, F.xxhash64("embedding").alias("mark"), "embedding")
    packed = marked.mapInArrow(pack, f"dim int, keys array<{kind}>, marks array<bigint>, vectors binary")
    return packed.withColumn("element", F.lit(element))


class _Best:
    """The best k hits of every query of one block, over the tiles seen so far: score descending, then chunk_id."""

    def __init__(self, queries: pa.Array, k: int) -> None:
        self.queries, self.k = queries, k
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.key, self.mark = np.zeros(0, object), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> None:
        rank = np.where(np.isnan(scores), np.inf, scores)  # NaN ranks first, as in the engine's descending order
        if len(rank) > self.k:
            row, query = np.nonzero(rank >= np.partition(rank, len(rank) - self.k, axis=0)[len(rank) - self.k])
        else:
            row, query = (x.ravel() for x in np.indices(rank.shape))
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, scores[row, query]])
        key, mark = np.concatenate([self.key, keys[row]]), np.concatenate([self.mark, marks[row]])
        by_name = np.unique(key, return_inverse=True)[1]
        order = np.lexsort((by_name, -np.where(np.isnan(score), np.inf, score), query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept = order[place < self.k]
        self.query, self.score, self.key, self.mark = query[kept], score[kept], key[kept], mark[kept]

    def rows(self) -> pa.RecordBatch:
        columns = [self.queries.take(pa.array(self.query)), pa.array(self.key, pa.string()), pa.array(self.mark), pa.array(self.score)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "mark", "similarity_score"])


def _tile_hits(k: int, lenient: bool):
    """Function of met pairs of a query block and a tile of chunks: each block's best hits, held while tiles follow."""

    def vectors(row: dict, side: str) -> np.ndarray:
        values = np.frombuffer(row[f"{side}_vectors"].as_buffer(), row[f"{side}_element"].as_py())
        return values.astype(np.float64).reshape(len(row[f"{side}_keys"].values), row[f"{side}_dim"].as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        for batch in batches:
            for values in zip(*batch.columns):
                row = dict(zip(batch.schema.names, values))
                if row["q_dim"] != row["t_dim"]:
                    if lenient:
                        continue
                    raise ValueError(f"stored vectors must have {row['q_dim'].as_py()} values")
                name = row["name"].as_py()
                if name not in held:
                    if len(held) == HELD:
                        yield held.pop(next(iter(held))).rows()
                    held[name] = _Best(row["q_keys"].values, k)
                keys = np.array(row["t_keys"].values.to_pylist(), dtype=object)
                marks = row["t_marks"].values.to_numpy(zero_copy_only=False)
                held[name].add(cosine_scores(vectors(row, "t"), vectors(row, "q")), keys, marks)
        yield from (best.rows() for best in held.values())

    return run


BROADCAST_BYTES = 8 << 20  # of query vectors that every task may hold


CELL_BYTES = 256 << 20  # of the smaller side that a cell of the grid holds, counted in doubles


def grid(asked: int, stored: int, cells: int) -> tuple[int, int]:
    """Rows and columns of at least ``cells`` cells, each with a bounded part of one side, that send the fewest bytes:
    queries go to a cell of every column, chunks to one of every row."""
    shapes = []
    for rows in range(1, max(cells, -(-asked // CELL_BYTES)) + 1):
        columns = -(-cells // rows)
        if asked / rows > CELL_BYTES:
            columns = max(columns, -(-stored // CELL_BYTES))
        shapes.append((rows, columns))
    return min(shapes, key=lambda shape: shape[1] * asked + shape[0] * stored)


PARTS = ("dim", "keys", "marks", "vectors", "element")


def _told(rows: DataFrame) -> tuple[int, int, set[int]]:
    """Number of rows, bytes of their vectors as doubles, and the lengths these have."""
    length = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    count, size, dims = rows.agg(F.count("*"), F.sum(length * 8 + 32), F.collect_set(length)).first()
    return count, size or 0, set(dims)


def _met(tiles: DataFrame, asked: DataFrame, size: int, stored: int) -> DataFrame:
    """Every tile with every block of queries; ``size`` and ``stored`` are the bytes of the queries' and chunks' vectors.

    Up to BROADCAST_BYTES of queries go to every task and the tiles stay where they were read; each tile finds one row,
    all blocks as an array. More of them meet the tiles by an equi-join on the cells of a grid: blocks are dealt to its
    rows and tiles to its columns, each sent to the cells of its row or column only. The grid has a few cells for each
    core, in the shape that sends the least.
    """
    spark = tiles.sparkSession
    left = [F.col(c).alias(f"t_{c}") for c in PARTS]
    if size <= BROADCAST_BYTES:
        row = F.struct("name", *[F.col(c).alias(f"q_{c}") for c in PARTS])
        blocks = asked.agg(F.collect_list(row).alias("blocks")).withColumn("all", F.lit(0))  # of checked size
        met = tiles.select(*left, F.lit(0).alias("all")).join(F.broadcast(blocks), "all")
        return met.select(F.explode("blocks").alias("block"), *[f"t_{c}" for c in PARTS]).select("block.*", *[f"t_{c}" for c in PARTS])
    rows, columns = grid(size, stored, 3 * spark.sparkContext.defaultParallelism)

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("keys"), F.lit(count))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))

    spread = asked.withColumn("row", dealt(rows)).withColumn("column", every(columns))
    placed = tiles.withColumn("column", dealt(columns)).withColumn("row", every(rows))
    spread = spread.select("row", "column", "name", *[F.col(c).alias(f"q_{c}") for c in PARTS])
    placed = placed.select("row", "column", *left)
    # A merge join streams its left side and holds a cell's rows of the right one.
    first, held = (placed, spread) if size / rows < stored / columns else (spread, placed)
    return first.join(held, ["row", "column"]).select(*spread.columns[2:], *placed.columns[2:])


HITS = "query_id bigint, chunk_id string, mark bigint, similarity_score double"
BINS = 4096
NARROW = 8  # further bins that a query looks into by itself; one that needs more meets every tile
ROUNDING = 1e-9  # of places
SOUND = (1e-100, 1e100)  # norms of vectors that are placed


def _places(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, -1 for null, and their places: the unit vector's component in a direction fixed for the
    length, NaN where there is no unit vector."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    places = np.full(len(lengths), np.nan)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == dim)
        values = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        way = np.random.default_rng(dim).normal(size=dim)
        with np.errstate(all="ignore"):
            norm = np.sqrt(np.einsum("ij,ij->i", values, values))
            place = np.round(values @ (way / np.linalg.norm(way)) / norm, 9)
        places[own] = np.where((norm > SOUND[0]) & (norm < SOUND[1]), place, np.nan)
    return lengths, places


def _cuts(lake: DataFrame, count: int) -> dict[int, np.ndarray]:
    """For each length of vectors the borders of bins that hold about TILE of the lake's places each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, places = _places(batch.column(0))
            told = ~np.isnan(places)
            yield pa.RecordBatch.from_arrays([pa.array(lengths[told], pa.int32()), pa.array(places[told])], names=["dim", "place"])

    bins = min(BINS, -(-count // TILE))
    shares = F.array(*[F.lit(n / bins) for n in range(1, bins)]) if bins > 1 else F.array(F.lit(0.5))
    rows = lake.select("embedding").mapInArrow(run, "dim int, place double")
    found = rows.groupBy("dim").agg(F.percentile_approx("place", shares, 4 * BINS).alias("cuts")).collect()  # few and bounded
    return {r["dim"]: np.unique(r["cuts"]) - ROUNDING / 2 for r in found}


def _binned(rows: DataFrame, cuts: dict[int, np.ndarray]) -> DataFrame:
    """Rows (key, mark, embedding, ...) with dim, place and bin; bin -1 and a null place for vectors that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, places = _places(batch.column("embedding"))
            bins = np.full(len(lengths), -1)
            for dim in np.unique(lengths).tolist():
                own = (lengths == dim) & ~np.isnan(places)
                bins[own] = np.searchsorted(cuts.get(dim, np.zeros(0)), places[own], "right")
            added = [pa.array(lengths, pa.int32()), pa.array(places, mask=np.isnan(places)), pa.array(bins, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "dim", "place", "bin"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, dim int, place double, bin int").where("dim >= 0")


def _packed_bins(rows: DataFrame, size: int, copies: int | None = None) -> DataFrame:
    """(bin and the columns of ``_packed``): up to so many vectors of one bin and length a row. Of equal vectors the
    ``copies`` first by key are enough, as no more of them can be among a query's best."""
    kind, element = dict(rows.dtypes)["key"], "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bins, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "bin", "mark"))
            ends = np.flatnonzero((dims[1:] != dims[:-1]) | (bins[1:] != bins[:-1])) + 1
            for at, end in zip([0, *ends], [*ends, len(batch)]):
                if at == end:
                    continue
                dim, own = int(dims[at]), batch.slice(at, end - at)
                values = own.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(element).reshape(end - at, dim)
                kept = np.arange(end - at)
                if copies is not None:
                    bits = values.view("u4" if element == "<f4" else "u8")
                    new = np.append(True, (marks[at + 1 : end] != marks[at : end - 1]) | (bits[1:] != bits[:-1]).any(axis=1))
                    kept = np.flatnonzero(kept - np.maximum.accumulate(np.where(new, kept, 0)) < copies)
                for part in (kept[n : n + size] for n in range(0, len(kept), size)):
                    ends_of = pa.array([0, len(part)], pa.int32())
                    keys, found = (own.column(c).take(pa.array(part)) for c in ("key", "mark"))
                    yield pa.RecordBatch.from_pydict({
                        "bin": pa.array([bins[at]], pa.int32()),
                        "dim": pa.array([dim], pa.int32()),
                        "keys": pa.ListArray.from_arrays(ends_of, keys),
                        "marks": pa.ListArray.from_arrays(ends_of, found),
                        "vectors": pa.array([values[part].tobytes()]),
                    })

    placed = rows.select("key", "mark", "embedding", "dim", "bin").hint("rebalance", "dim", "bin")
    placed = placed.sortWithinPartitions("dim", "bin", "mark", "key")
    packed = placed.mapInArrow(pack, f"bin int, dim int, keys array<{kind}>, marks array<bigint>, vectors binary")
    return packed.withColumn("element", F.lit(element))


def _by_bins(lake: DataFrame, queries: DataFrame, asked_dims: set[int], k: int, lenient: bool, block: int) -> DataFrame:
    """(query_id, chunk_id, mark, similarity_score) that hold every query's best k, for more queries than go to every task.

    Vectors are placed on a line, and no two places lie farther apart than their unit vectors do. So a query first
    meets the chunks of its own bin of the line; its k-th score there tells how far the better ones may lie. Queries
    that reach into few other bins meet those, the others meet every tile, as do all queries the tiles of vectors that
    have no place (zero vectors score NaN with all). Nothing is left out that could be among the best.
    """
    spark, work = lake.sparkSession, scratch_dir(lake.sparkSession, "search")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    count, size, dims = _told(lake)
    if not lenient and asked_dims and len(asked_dims | dims) > 1:
        raise ValueError(f"stored vectors must have {min(asked_dims)} values")
    cuts = _cuts(lake, count)
    mark = F.xxhash64("embedding").alias("mark")
    tiles = stored(_packed_bins(_binned(lake.select(F.col("chunk_id").alias("key"), mark, "embedding"), cuts), TILE, k), "tiles")
    numbered = queries.select(F.monotonically_increasing_id().alias("key"), mark, "embedding", F.col("query_id").cast("bigint").alias("query_id"))
    asked = stored(_binned(numbered, cuts), "queries")

    def blocks(rows: DataFrame) -> DataFrame:
        return _packed_bins(rows, block).withColumn("name", F.xxhash64("keys", "vectors")).drop("marks")

    def in_bins(rows: DataFrame) -> DataFrame:
        left = blocks(rows.where("bin >= 0")).select("bin", "dim", "name", *[F.col(c).alias(f"q_{c}") for c in PARTS if c != "marks"])
        right = tiles.where("bin >= 0").select("bin", "dim", *[F.col(c).alias(f"t_{c}") for c in PARTS])
        met = left.join(right, ["bin", "dim"]).drop("bin", "dim")
        return met.mapInArrow(_tile_hits(k, lenient), HITS).withColumnRenamed("query_id", "key")

    def of_all(rows: DataFrame, among: DataFrame) -> DataFrame:
        rows = rows.select("key", "embedding")
        packed = _packed(rows, "key", block).withColumn("name", F.xxhash64("keys", "vectors"))
        met = _met(among, packed, _told(rows)[1], size).drop("q_marks")
        return met.mapInArrow(_tile_hits(k, lenient), HITS).withColumnRenamed("query_id", "key")

    ranked = Window.partitionBy("key").orderBy(F.desc("similarity_score"), "chunk_id")
    own = in_bins(asked).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank")
    own = stored(own, "own")
    reached = own.groupBy("key").agg(F.when(F.count("*") >= k, F.min("similarity_score")).alias("least"))
    # The score is less exact with more numbers; squares of distances between unit vectors are 2 - 2 cosines.
    slack = F.lit(1e-12) + F.col("dim") * 1e-15
    reach = F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0)) + slack) + 2 * ROUNDING
    state = asked.select("key", "dim", "place", "bin").join(reached, "key", "left").withColumn("reach", reach)

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, places, reach = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "place", "reach"))
            low, high = np.zeros(len(dims), np.int64), np.full(len(dims), BINS)
            for dim in np.unique(dims).tolist():
                mine = (dims == dim) & ~np.isnan(places + reach)
                low[mine], high[mine] = (np.searchsorted(cuts.get(dim, np.zeros(0)), (places + way * reach)[mine], "right") for way in (-1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("bin"), pa.array(low), pa.array(high)], names=["key", "bin", "low", "high"])

    state = state.mapInArrow(span, "key bigint, bin int, low bigint, high bigint")
    state = stored(state.withColumn("wide", F.col("high") - F.col("low") > NARROW), "state")
    wide, more = state.agg(F.bool_or("wide"), F.bool_or(~F.col("wide") & (F.col("high") > F.col("low")))).first()
    near = state.where(~F.col("wide"))
    hits = own.join(near.select("key"), "key", "left_semi")
    if more:
        others = near.withColumn("other", F.explode(F.sequence("low", "high"))).where("other <> bin")
        rows = asked.drop("bin").join(others.select("key", F.col("other").cast("int").alias("bin")), "key")
        hits = hits.unionByName(in_bins(rows))
    if wide:
        hits = hits.unionByName(of_all(asked.join(state.where("wide").select("key"), "key", "left_semi"), tiles.drop("bin")))
    odd = tiles.where("bin < 0").drop("bin")
    if not odd.isEmpty():
        hits = hits.unionByName(of_all(asked.join(near.select("key"), "key", "left_semi"), odd))
    return hits.join(asked.select("key", "query_id"), "key").drop("key")


def multi_query_search(
    lake: DataFrame, queries: DataFrame, k: int = 5, lenient: bool = False, block: int = QUERY_BLOCK
) -> DataFrame:
    """Top k per query for a table of queries (query_id, embedding); query_id is unique, null vectors find nothing.

    Both sides are packed into rows of bounded size, and every block of queries meets every tile of chunks, but for pairs
    of many queries that ``_by_bins`` rules out. A task keeps k hits per query while it works through its tiles, nothing
    goes through the driver. The other columns are read for the winners only, found again by chunk_id and, in what that finds,
    a hash of the vector; a lake given with chunk_id and embedding alone needs no second look.
    """
    columns = [c for c in HIT_COLUMNS if c in lake.columns]
    _, size, dims = _told(queries)
    if size > BROADCAST_BYTES:
        hits = _by_bins(lake.select("chunk_id", "embedding"), queries, dims, k, lenient, block)
    else:
        tiles = _packed(lake.select("chunk_id", "embedding"), "chunk_id", TILE)
        asked = _packed(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding"), "query_id", block)
        met = _met(tiles, asked.withColumn("name", F.xxhash64("keys", "vectors")), size, 0).drop("q_marks")
        hits = met.mapInArrow(_tile_hits(k, lenient), HITS)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity_score"), "chunk_id")
    best = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    if columns == ["chunk_id"]:
        return best.select("chunk_id", "query_id", "similarity_score", "rank")
    winners = best.select("query_id", "chunk_id", "mark", "similarity_score").distinct()
    found = lake.select(*columns, "embedding").join(winners, "chunk_id").where(F.xxhash64("embedding") == F.col("mark"))
    found = found.select(*columns, "query_id", "similarity_score")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
