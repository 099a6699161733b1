"""Hard negatives by BOND: a vertical scan over columnar dimensions with a shrinking candidate bitmap.

Vectors are packed into tiles that hold one array a dimension, in order of label, with the least and the greatest value
of every dimension. An anchor reads a tile's dimensions in descending order of its own components. After every few of
them, a row's score lies between its partial sum plus the least and plus the greatest that the unread dimensions can add;
rows that can no longer be among those asked for leave the bitmap, and only rows in it are read further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

SCALE = 256.0
LARGEST = 1 << 24  # scaled components beyond it count as it, so that inner products fit 64 bits
TILE = 16_384  # rows of a tile
ANCHORS = 4096  # anchors that meet a tile at once
STRIDE = 8  # dimensions read between two looks at the bitmap

SCALED = "id long, label long, dims int, vector binary"
TILES = "tile long, dims int, ids binary, labels binary, columns binary"


def scaled(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, integer vectors as rows) of a batch's sound rows, once for each number of dimensions."""
    ids, labels, vectors = batch.columns
    at = np.flatnonzero(np.array(ids.is_valid()) & np.array(labels.is_valid()) & np.array(vectors.is_valid()))
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[at]
    for dims in np.unique(sizes[sizes > 0]).tolist():
        own = at[sizes == dims]
        flat = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dims)
        sound = np.isfinite(flat).all(axis=1)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(scale * flat[sound]), -LARGEST, LARGEST).astype(np.int64)
        own = pa.array(own[sound])
        yield ids.take(own).to_numpy(), labels.take(own).to_numpy(), whole


def _narrowest(values: np.ndarray) -> np.ndarray:
    fits = not values.size or np.abs(values).max() < 1 << 15
    return np.ascontiguousarray(values.astype(np.int16 if fits else np.int32))


def _opened(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * count else np.int32)


def _rows(rows: DataFrame, scale: float) -> DataFrame:
    """Scaled vectors, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, whole in scaled(batch, scale):
                yield pa.RecordBatch.from_pydict({
                    "id": ids, "label": labels, "dims": pa.array([whole.shape[1]] * len(ids), pa.int32()),
                    "vector": pa.array([v.tobytes() for v in whole.astype(np.int32)], pa.binary()),
                })

    return rows.mapInArrow(run, SCALED)


def _tiles(rows: DataFrame, scale: float, size: int) -> DataFrame:
    """Scaled vectors packed by dimension: each task fills tiles from the rows it reads, nothing is shuffled."""
    def pack(tile: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, labels, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(labels, kind="stable")
        return pa.RecordBatch.from_pydict({
            "tile": [tile], "dims": pa.array([whole.shape[1]], pa.int32()), "ids": [ids[order].astype(np.int64).tobytes()],
            "labels": [labels[order].astype(np.int64).tobytes()], "columns": [_narrowest(whole[order].T).tobytes()],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        tile = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in scaled(batch, scale):
                own = held.setdefault(part[2].shape[1], [])
                own.append(part)
                while (n := sum(len(x[0]) for x in own)) >= size:
                    last = own.pop()
                    cut = len(last[0]) - (n - size)
                    yield pack(tile, [*own, tuple(x[:cut] for x in last)])
                    tile += 1
                    own[:] = [tuple(x[cut:] for x in last)] if n > size else []
        for own in held.values():
            if own:
                yield pack(tile, own)
                tile += 1

    return rows.mapInArrow(run, TILES)


@dataclass
class Tile:
    """Columns of integers held as numbers in which every inner product is exact."""

    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray
    bounds: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def open(cls, row: dict, most: int) -> Tile:
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        whole = _opened(row["columns"], row["dims"] * len(ids)).reshape(row["dims"], len(ids))
        largest = int(np.abs(whole.astype(np.int64)).max()) * most * row["dims"]
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
        return cls(ids, labels, whole.astype(kind), {})

    def part(self, label: int) -> tuple[int, int]:
        """The rows of a label."""
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())

    def reach(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest value of every dimension in some rows."""
        if (start, end) not in self.bounds:
            held = self.columns[:, start:end]
            self.bounds[start, end] = held.min(axis=1), held.max(axis=1)
        return self.bounds[start, end]


def scan(anchor: np.ndarray, tile: Tile, start: int, end: int, bitmap: np.ndarray | None, narrow: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the tile between `start` and `end` that `narrow` leaves, and their scores.

    narrow(scores, low, high) is given partial scores and what the unread dimensions add at least and at most, and
    tells which rows stay.
    """
    columns = tile.columns[:, start:end]
    anchor = anchor.astype(columns.dtype)
    order = np.argsort(-np.abs(anchor), kind="stable")
    least, greatest = tile.reach(start, end)
    ends = np.stack([anchor * least, anchor * greatest])[:, order].astype(np.int64 if columns.dtype == np.int64 else np.float64)
    low, high = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(axis=0), ends.max(axis=0)))
    at = None if bitmap is None else np.flatnonzero(bitmap)
    scores = np.zeros(end - start if at is None else len(at), columns.dtype)
    for first in range(0, len(order), STRIDE):
        dims = order[first:first + STRIDE]
        read = columns[dims] if at is None else columns[dims[:, None], at]
        scores = scores + anchor[dims] @ read
        stays = narrow(scores, low[min(first + STRIDE, len(order))], high[min(first + STRIDE, len(order))])
        if stays is not None and (count := np.count_nonzero(stays)) < len(scores) * 0.7:
            at = np.flatnonzero(stays) if at is None else at[stays]
            scores = scores[stays]
            if not count:
                break
    at = np.arange(end - start) if at is None else at
    return at + start, scores.astype(np.int64)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the highest scores, equal scores by id."""
    at = np.arange(len(ids))
    if len(ids) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def best(anchor: np.ndarray, own: int, label: int, tile: Tile, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a label but those of the anchor's own id."""
    start, end = tile.part(label)
    others = tile.ids[start:end] != own
    if not others.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def narrow(scores: np.ndarray, low: float, high: float) -> np.ndarray | None:
        if len(scores) <= k or high - low >= scores.max() - scores.min():
            return None
        return scores + high >= np.partition(scores, -k)[-k] + low

    at, scores = scan(anchor, tile, start, end, None if others.all() else others, narrow)
    chosen = _first(tile.ids[at], scores, k)
    return tile.ids[at][chosen], scores[chosen]


def within(anchor: np.ndarray, label: int, windows: np.ndarray, tile: Tile, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each window of scores (least, greatest), its number and the ids and scores of the k best rows of other labels."""
    start, end = tile.part(label)
    out = []
    lowest, highest = windows[:, 0].min(), windows[:, 1].max()

    def narrow(scores: np.ndarray, low: float, high: float) -> np.ndarray | None:
        if high - low > scores.max() - scores.min() + highest - lowest:
            return None
        stays = (scores + high >= lowest) & (scores + low <= highest)
        if high - low > highest - lowest or np.count_nonzero(stays) <= k:
            return stays
        kept = np.zeros(len(scores), bool)
        for a, b in windows:  # a row surely in a window k times over keeps out all that cannot reach those
            sure = scores[stays & (scores + low >= a) & (scores + high <= b)]
            need = a if len(sure) < k else max(a, np.partition(sure, -k)[-k] + low)
            kept |= stays & (scores + high >= need) & (scores + low <= b)
        return kept

    parts = [scan(anchor, tile, a, b, None, narrow) for a, b in ((0, start), (end, len(tile.ids))) if a < b]
    if not parts:
        return out
    at, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
    for i, (a, b) in enumerate(windows):
        own = (scores >= a) & (scores <= b)
        if own.any():
            ids, kept = tile.ids[at[own]], scores[own]
            chosen = _first(ids, kept, k)
            out.append((i, ids[chosen], kept[chosen]))
    return out


def _cells(tiles: DataFrame, anchors: DataFrame, slots: int, groups: int, work: Callable, schema: str) -> DataFrame:
    """Every tile with every group of anchors, once: a cell holds the tiles of a slot and one group."""
    left = tiles.withColumn("slot", F.pmod(F.xxhash64("tile"), F.lit(slots)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    right = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    )

    def run(tiles: pa.Table, anchors: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(4)]
        if len(tiles) and len(anchors):
            asked = anchors.to_pylist()
            for a in asked:
                a["vector"] = np.frombuffer(a["vector"], np.int32).astype(np.int64)
            most = max(int(np.abs(a["vector"]).max()) for a in asked)
            for batch in tiles.to_batches(max_chunksize=1):
                tile_row = batch.to_pylist()[0]
                tile = Tile.open(tile_row, most)
                for a in asked:
                    if a["dims"] != tile_row["dims"]:
                        continue
                    for number, ids, scores in work(tile, a):
                        for column, x in zip(columns, ([a["anchor"]] * len(ids), [number] * len(ids), ids, scores), strict=True):
                            column.append(np.asarray(x, np.int64))
        arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        return pa.table(dict(zip(("anchor", "number", "id", "score"), map(pa.array, arrays), strict=True)))

    return left.groupBy("slot", "group").cogroup(right.groupBy("slot", "group")).applyInArrow(run, schema)


FOUND = "anchor long, number long, id long, score long"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", scale: float = SCALE, positives: int = 5, negatives: int = 5,
                   percent: tuple[int, int] = (80, 100), tile: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that `anchor` picks and
    each of its positives, the best negatives.

    A score is the inner product of vectors scaled to floor(scale * x). Higher scores come first, equal scores by
    smaller id. Positives are the first rows of the anchor's label under another id; the negatives of a positive are the
    first rows of other labels whose score lies between percent[0] and percent[1] hundredths of its score. A positive
    without such rows has none here.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Only vectors
    of equally many dimensions are compared. Scaled components beyond 2^24 count as 2^24. Repeated rows are rows of
    their own, as anchors too. Other columns are ignored; no rows give none.

    All rows are scanned once for the positives and once for the negatives, in tiles that meet groups of anchors; both
    are of bounded size, whatever labels or copies are frequent. A cell sends on at most `positives` rows an anchor, or
    `negatives` rows a positive.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")
    )
    packed = stored(_tiles(rows, scale, tile), "tiles")
    chosen = vectors.where(anchor).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")
    )
    asked = stored(_rows(chosen, scale).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    width = packed.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0
    count = asked.count()
    slots = int(width // tile) + 1
    tasks = 2 * packed.sparkSession.sparkContext.defaultParallelism
    groups = max(count // ANCHORS + 1, -(-tasks // slots))

    def find_positives(t: Tile, a: dict) -> Iterator[tuple]:
        yield 0, *best(a["vector"], a["id"], a["label"], t, positives)

    found = _cells(packed, asked, slots, groups, find_positives, FOUND)
    first = stored(_top(found, positives).select("anchor", F.col("rank").alias("number"), "id", "score"), "positives")
    low, high = percent

    def find_negatives(t: Tile, a: dict) -> Iterator[tuple]:
        windows = np.array([(-(-low * p["score"] // 100), high * p["score"] // 100) for p in a["asked"]], np.int64)
        open_ = np.flatnonzero(windows[:, 0] <= windows[:, 1])
        if len(open_):
            for i, ids, scores in within(a["vector"], a["label"], windows[open_], t, negatives):
                yield a["asked"][open_[i]]["number"], ids, scores

    windows = first.groupBy("anchor").agg(F.collect_list(F.struct("number", "score")).alias("asked"))  # `positives` at most
    found = _cells(packed, asked.join(windows, "anchor"), slots, groups, find_negatives, FOUND)
    chosen = _top(found, negatives).alias("n")
    return chosen.join(first.alias("p"), F.expr("n.anchor = p.anchor AND n.number = p.number")).join(
        asked.select("anchor", F.col("id").alias("anchor_id")).alias("a"), F.expr("n.anchor = a.anchor")
    ).select(
        "a.anchor_id", F.col("p.id").alias("positive_id"), "n.rank", F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
