"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, runs, stored, utf8, words
from quire.llm.graph import components

SEED = 42  # of the shingle hashes
TILE = 16384  # fingerprints of a tile
BLOCK = 1 << 18  # shingles whose bits are added up at once


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit fingerprint of each row of lower-cased bytes; rows without words have 0."""
    starts, ends, first = words(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    text = data.tobytes()
    parts = [text[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    for i in range(len(out)):
        own = parts[first[i] : first[i + 1]]
        if not own:
            continue
        line = b" ".join(own)
        n = max(1, len(own) - width + 1)
        if len(own) <= width:
            hashes = np.array([digest(line, SEED)], np.uint64)
        else:
            end = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
            begin = np.concatenate([[0], end[: n - 1] + 1])
            hashes = np.fromiter(
                (digest(line[s:e], SEED) for s, e in zip(begin.tolist(), end[width - 1 :].tolist(), strict=True)),
                np.uint64, n,
            )
        votes = np.zeros(64, np.int64)
        for at in range(0, n, BLOCK):
            bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def simhash(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit number. Null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            fps = [
                fingerprints(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], width)
                for a, b in runs(offsets)
            ]
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(held.dtypes)["id"]
    return held.mapInArrow(run, f"id {kind}, fp bigint")


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters of each fingerprint."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class _Forest:
    """Union-find over the rows of one tile pair: of all links found it keeps those that join something."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between two tiles that span the same groups as all pairs within the radius.

    Rows of one tile with equal quarter counts are compared at once, with those rows of the other whose quarter counts
    differ by no more than the radius altogether: fewer differing bits are impossible elsewhere.
    """
    own, other = _quarters(left), _quarters(right)
    kinds, kind = np.unique(own, axis=0, return_inverse=True)
    by_kind = np.split(np.argsort(kind.ravel(), kind="stable"), np.cumsum(np.bincount(kind.ravel()))[:-1])
    forest, links = _Forest(len(left) + len(right)), []
    for counts, rows in zip(kinds, by_kind, strict=True):
        near = np.flatnonzero(np.abs(other - counts).sum(axis=1) <= radius)
        for at in range(0, len(rows) if len(near) else 0, 64):
            some = rows[at : at + 64]
            i, j = np.nonzero(np.bitwise_count(left[some][:, None] ^ right[near][None, :]) <= radius)
            for x, y in zip(some[i].tolist(), near[j].tolist(), strict=True):
                if left[x] != right[y] and forest.join(x, len(left) + y):
                    links.append((x, y))
    return links


def fingerprint_links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b) links between different fingerprints of a table of distinct ones (fp), enough to span every group of
    fingerprints linked at `radius` or fewer bits.

    The fingerprints are ordered by population count and cut into tiles of bounded size. Tiles meet where their ranges
    of population counts, widened by the radius, meet: a join on the count, once per pair. Copies of a fingerprint
    never get here, and a tile pair returns a spanning forest instead of all its links.
    """
    spark = prints.sparkSession

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.zeros(0, np.int64)
        for pdf in frames:
            rest = np.concatenate([rest, pdf["fp"].to_numpy(np.int64)])
            while len(rest) >= tile:
                yield packed(rest[:tile])
                rest = rest[tile:]
        if len(rest):
            yield packed(rest)

    def packed(fp: np.ndarray) -> pd.DataFrame:
        bits = np.bitwise_count(fp.view(np.uint64))
        return pd.DataFrame({"tile": [int(fp[0])], "low": [int(bits.min())], "high": [int(bits.max())], "fps": [fp.tobytes()]})

    ordered = prints.select("fp", F.bit_count("fp").alias("bits")).repartitionByRange("bits", "fp")
    tiles = stored(
        ordered.sortWithinPartitions("bits", "fp").select("fp").mapInPandas(cut, "tile long, low int, high int, fps binary"),
        "tiles",
    )
    met = tiles.select("tile", "low", "high", F.explode(F.sequence(F.col("low"), F.col("high"))).alias("bits"))
    wide = tiles.select("tile", "low", "high", F.explode(F.expr(f"sequence(low, high + {radius})")).alias("bits"))
    pairs = (
        met.alias("x").join(wide.alias("y"), "bits").where("y.low <= x.low AND NOT (y.low = x.low AND y.tile > x.tile)")
        .select(F.col("y.tile").alias("one"), F.col("x.tile").alias("two")).distinct()
    )
    blobs = tiles.select("tile", "fps")
    work = (
        pairs.join(blobs.toDF("one", "left"), "one").join(blobs.toDF("two", "right"), "two")
        .select("left", "right").repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                left, right = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, two))
                found = np.array(tile_links(left, right, radius), np.int64).reshape(-1, 2)
                ends = [pa.array(left[found[:, 0]].view(np.int64)), pa.array(right[found[:, 1]].view(np.int64))]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return work.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    radius: int = 3) -> DataFrame:
    """(id, fp, component): every document with its fingerprint and the smallest id reachable over links of fingerprints
    that differ in `radius` or fewer bits.

    Words are split at white space after A-Z are lower-cased; a text of fewer words than a shingle is one shingle.
    Null, empty and blank texts have fingerprint 0 and link like any other. Rows with equal fingerprints are one class,
    so copies cost a row each and no pairs. A null id never names a component unless a class has no other.
    An empty table gives no rows.
    """
    prints = stored(simhash(docs, id_col, text_col, width), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    joined = components(fingerprint_links(classes.select("fp"), radius), "a", "b")
    grouped = classes.join(joined, classes["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("part")
    )
    names = grouped.groupBy("part").agg(F.min("least").alias("component"))
    named = grouped.join(names, "part").select("fp", F.col("component"))
    return prints.join(named, "fp").select("id", "fp", "component")
