"""Suffix-array dedup: bytes under long strings that occur elsewhere are removed, found by induced sorting of shards."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import POWERS, mixed, stored

LENGTH = 400
SHARD = 6 << 20  # bytes of text sorted at once; a larger group of its own is one shard
COMMON = 4096  # different pieces of a group that is sorted; a group of more is divided
HELD = 128 << 20  # bytes of queued suffixes in memory; more go to disk
WINDOW = 1 << 20  # starts of strings of one text whose anchors are found at once


# --- suffix sorting ---------------------------------------------------------------------------------------------------


class Queues:
    """A priority queue of suffixes by first character, first in first out within one. What is pushed beyond a bound is
    kept in an unnamed file of the task, which ends with it."""

    def __init__(self, sigma: int, held: int = HELD) -> None:
        self.blocks: list[list] = [[] for _ in range(sigma)]
        self.room, self.file = held, None

    def push(self, suffixes: np.ndarray, chars: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(chars, kind="stable")
        suffixes, chars = suffixes[order], chars[order]
        cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        for c, block in zip(chars[np.concatenate([[0], cuts])].tolist(), np.split(suffixes, cuts), strict=True):
            if self.room >= block.nbytes:
                self.room -= block.nbytes
                self.blocks[c].append(block)
            else:
                self.file = self.file or tempfile.TemporaryFile()
                self.blocks[c].append((self.file.seek(0, 2), len(block), block.dtype))
                self.file.write(block.tobytes())

    def pop(self, c: int) -> np.ndarray:
        """All suffixes queued under a character, in the order they came."""
        out = []
        for block in self.blocks[c]:
            if isinstance(block, tuple):
                self.file.seek(block[0])
                block = np.frombuffer(self.file.read(block[1] * block[2].itemsize), block[2])
            else:
                self.room += block.nbytes
            out.append(block)
        self.blocks[c] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def _types(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one; the last one counts as smaller."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    nearest = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return np.append(t[:-1] < t[1:], True)[nearest]


def _induce(t: np.ndarray, smaller: np.ndarray, sigma: int, seeds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From sorted left-most smaller suffixes the order of all: per character, the larger ones and the smaller ones.

    A pass takes the queue's least (then greatest) character, all its suffixes at once; each suffix brings up the one
    before it, under that one's character, so order is handed on without a comparison.
    """
    bounds = np.searchsorted(t[seeds], np.arange(sigma + 1))
    queue, larger, less = Queues(sigma), [], []
    for c in range(sigma):
        done, batch = [], queue.pop(c)
        while len(batch):
            done.append(batch)
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            chars = t[before]
            batch = before[chars == c]
            queue.push(before[chars != c], chars[chars != c])
        larger.append(np.concatenate(done) if done else np.zeros(0, np.int32))
        before = seeds[bounds[c] : bounds[c + 1]]
        before = before[before > 0] - 1
        queue.push(before, t[before])
    for c in range(sigma - 1, -1, -1):
        done, batch = [], queue.pop(c)
        while len(batch):
            done.append(batch)
            before = batch[batch > 0] - 1
            before = before[smaller[before]]
            chars = t[before]
            batch = before[chars == c]
            queue.push(before[chars != c], chars[chars != c])
        less.append(np.concatenate(done)[::-1] if done else np.zeros(0, np.int32))
        before = larger[c][::-1]
        before = before[before > 0] - 1
        before = before[smaller[before]]
        queue.push(before, t[before])
    less.reverse()
    less[int(t[-1])] = np.concatenate([[len(t) - 1], less[int(t[-1])]]).astype(np.int32)
    return larger, less


def _named(t: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of sorted substrings, equal for equal ones; `ends` gives each one's length by its place."""
    a, b = order[:-1], order[1:]
    live = np.flatnonzero(ends[a] == ends[b])
    same, j = np.zeros(len(a), bool), 0
    while len(live):
        live = live[t[a[live] + j] == t[b[live] + j]]
        over = ends[a[live]] <= j
        same[live[over]] = True
        live = live[~over]
        j += 1
    return np.concatenate([[0], np.cumsum(~same)])


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first `depth` names at least."""
    rank, k = names.astype(np.int64), 1
    n = len(rank)
    while True:
        following = np.zeros(n, np.int64)
        following[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        k *= 2
        if k >= depth or k >= n or rank.max() == n - 1:
            return order


def suffix_array(t: np.ndarray, sigma: int, depth: int = 1 << 62) -> np.ndarray:
    """Starts of the suffixes of t in order, at least by their first `depth` characters. t holds numbers below sigma;
    its last one is the only 0.

    Left-most smaller substrings are sorted by induction and named; where names repeat, the string of names is sorted
    in turn, by the same induction while it has few names for its length and by doubling once it has many; induction
    from the left-most smaller suffixes then orders the rest.
    """
    smaller = _types(t)
    marks = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if len(marks) == 0:
        return np.argsort(t, kind="stable")
    seeds = marks[np.argsort(t[marks], kind="stable")]
    _, less = _induce(t, smaller, sigma, seeds)
    is_mark = np.zeros(len(t), bool)
    is_mark[marks] = True
    order = np.concatenate(less)
    order = order[is_mark[order]]
    ends = np.zeros(len(t), np.int32)
    ends[marks[:-1]] = np.diff(marks)
    names = _named(t, order, ends)
    if names[-1] < len(order) - 1:
        at = np.zeros(len(t), np.int32)
        at[order] = names
        string = at[marks]
        few = int(names[-1]) + 1
        below = suffix_array(string, few, depth // 2 + 1) if few <= 4096 and few * 64 < len(string) else _doubled(string, depth // 2 + 1)
        order = marks[below]
    larger, less = _induce(t, smaller, sigma, order)
    return np.concatenate([x for pair in zip(larger, less, strict=True) for x in pair])


def common_prefixes(text: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Of neighbouring starts the length of the common prefix, in whole eights up to `most` (itself a multiple)."""
    padded = np.concatenate([text, np.zeros(most + 8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), np.uint64, padded, 0, (1,))
    a, b = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for j in range(0, most, 8):
        live = live[eights[a[live] + j] == eights[b[live] + j]]
        out[live] = j + 8
        if not len(live):
            break
    return out


def repeated_starts(pieces: list[bytes], times: list[int], length: int) -> list[np.ndarray]:
    """For each piece, which of its starts of a string of `length` bytes has that string elsewhere in the pieces, or in
    a piece that stands for several."""
    sizes = np.array([len(p) + 1 for p in pieces])
    at = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8)
    t = joined.astype(np.int32) + 2
    t[at[1:] - 1] = 1
    t[-1] = 0
    first = np.zeros(len(t), bool)
    for i, piece in enumerate(pieces):
        first[at[i] : at[i] + max(0, len(piece) - length + 1)] = True
    order = suffix_array(t, 258, length)
    order = order[first[order]]
    equal = common_prefixes(joined, order, length) >= length
    found = np.zeros(len(t), bool)
    found[order[:-1][equal]] = True
    found[order[1:][equal]] = True
    return [
        found[at[i] : at[i] + max(0, len(p) - length + 1)] | (times[i] > 1) for i, p in enumerate(pieces)
    ]


# --- sharding ---------------------------------------------------------------------------------------------------------


def anchored(data: np.ndarray, length: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts (first, last, anchor): all strings of `length` bytes that start in a run have their least half,
    by hash and then from the left, at the anchor. Equal strings have it at the same distance.

    A text is gone through `window` starts at a time, and a run that reaches over a border is put together again, so
    what is held besides the text is a bounded number of bytes and the runs."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    parts = [(at, _anchors(data[at : at + window + length - 1], length)) for at in range(0, n, window)]
    first = np.concatenate([at + f for at, (f, _) in parts])
    anchor = np.concatenate([at + a for at, (_, a) in parts])
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    first = first[new]
    return first, np.append(first[1:] - 1, n - 1), anchor[new]


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First starts and anchors of the runs of one window."""
    half = length // 2
    n = len(data)
    up, down = POWERS.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = mixed((sums[half:] - sums[:-half]) * down[: n - half + 1])
    value = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    w = length - half + 1
    grid = np.full(-(-len(value) // w) * w, ~np.uint64(0))
    grid[: len(value)] = value
    grid = grid.reshape(-1, w)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = (np.minimum(back[:windows], fore[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first, least[first]


def _runs(keys: list, flags: list[np.ndarray], shifts: list[int]) -> list[tuple]:
    """(key..., first start, last start) for every run of true flags."""
    out = []
    for key, flag, shift in zip(keys, flags, shifts, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
        out += [(*key, shift + int(a), shift + int(b) - 1) for a, b in edge.reshape(-1, 2)]
    return out


SEGMENT = "key long, anchor long, content long, first long, span int, off int, times int"


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The runs of starts of each text, by anchor and content. Equal runs of one text are one row with their number, and
    their starts, which all repeat, come at once as rows without anchor: one for each stretch, so a text that repeats a
    short pattern costs a few rows however long it is."""
    half = length // 2
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 7
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            found: list[tuple] = []
            known: list[tuple] = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                first, last, anchor = anchored(np.frombuffer(raw, np.uint8), length)
                hashed = [
                    (xxhash.xxh3_64_intdigest(raw[a : a + half]), xxhash.xxh3_64_intdigest(raw[f : e + length]))
                    for f, e, a in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)
                ]
                anchors, contents = np.array(hashed, np.uint64).reshape(-1, 2).view(np.int64).T
                _, own, kind, times = np.unique(contents, return_index=True, return_inverse=True, return_counts=True)
                if len(own) < len(contents):
                    again = times[kind] > 1
                    low, high = first[again], last[again]
                    cuts = np.flatnonzero(low[1:] != high[:-1] + 1) + 1
                    low, high = low[np.append(0, cuts)], high[np.append(cuts - 1, len(high) - 1)]
                    known.append((np.full(len(low), key), low, high - low))
                keys = np.full(len(own), key, np.int64)
                found.append((keys, anchors[own], contents[own], first[own], (last - first)[own], (anchor - first)[own], times))
            yield rows(found)
            if known:
                keys, low, span = (np.concatenate(x) for x in zip(*known, strict=True))
                none = pa.nulls(len(keys), pa.int64())
                columns = [pa.array(keys), none, none, pa.array(low), pa.array(span).cast(pa.int32())]
                columns += [pa.nulls(len(keys), pa.int32())] * 2
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _sort_shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces come ordered by group. Whole groups of two or more are gathered to shards, sorted, and give the runs of
    repeated starts of those pieces that stand for themselves only."""
    shard: list[tuple] = []
    group: list[tuple] = []
    size, current = 0, None

    def close() -> Iterator[pa.RecordBatch]:
        flags = repeated_starts([x[3] for x in shard], [x[2] for x in shard], length)
        alone = [i for i, x in enumerate(shard) if x[2] == 1]
        rows = _runs([(shard[i][0],) for i in alone], [flags[i] for i in alone], [shard[i][1] for i in alone])
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "low", "high"])

    for batch in batches:
        for name, *piece in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if name != current:
                if len(group) > 1:
                    shard += group
                    size += sum(len(x[3]) for x in group)
                if size >= SHARD:
                    yield from close()
                    shard, size = [], 0
                group, current = [], name
            group.append(tuple(piece))
    if len(group) > 1:
        shard += group
    if shard:
        yield from close()


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes under strings that start in the given runs."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            rows = []
            for text, spans in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, end, removed, n_spans = [], 0, 0, 0
                stop = -1
                for low, high in sorted((x["low"], x["high"] + length) for x in spans or ()):
                    if low > stop:
                        kept.append(raw[end:low])
                        n_spans += 1
                        removed += high - low
                    else:
                        removed += max(0, high - stop)
                    stop = end = max(stop, high)
                kept.append(raw[end:])
                rows.append((len(raw), removed, n_spans, b"".join(kept)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _parted(pieces: DataFrame, parts: int, length: int) -> DataFrame:
    """Pieces cut into parts by where a string starts against the anchor, and grouped by all bytes that every string of
    a part covers. A piece (group, key, at, low, high, times, a, b, piece) holds the bytes of the strings that start
    from low to high; they start from a to b against the anchor at `at`."""
    part = F.explode(F.expr(
        f"transform(sequence(0, {parts - 1}), i -> struct(CAST(a + (b - a + 1) * i DIV {parts} AS INT) AS a,"
        f" CAST(a + (b - a + 1) * (i + 1) DIV {parts} - 1 AS INT) AS b))"
    ))
    cut = pieces.withColumn("r", part).withColumns({"start": F.expr("greatest(low, at + r.a)"), "stop": F.expr("least(high, at + r.b)")})
    core = F.expr(f"substring(piece, CAST(at + r.b - low AS INT) + 1, {length} - r.b + r.a)")
    own = F.expr(f"substring(piece, CAST(start - low AS INT) + 1, CAST(stop - start AS INT) + {length})")
    return cut.where("start <= stop").select(
        F.xxhash64("group", "r.a", core).alias("group"), "key", "at", F.col("start").alias("low"), F.col("stop").alias("high"),
        "times", "r.a", "r.b", own.alias("piece"),
    )


def _divided(pieces: DataFrame, length: int, common: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One division of the pieces of frequent anchors: those of groups small enough to be sorted, the runs (key, low,
    high) of starts that repeat because whole parts are equal, and the pieces to be divided again, or None.

    Equal parts of one group become one with their number. Of a passage that many documents have, a part that lies
    inside it becomes one row, one that reaches beyond it is alone in its group, and only the part with the passage's
    edge goes on, until it is a single start: groups of any size end without being gathered.
    """
    named = _parted(pieces, 4, length).withColumn("content", F.xxhash64(F.expr("low - at"), F.expr("high - at"), "piece"))
    named = stored(named, "parts")
    rest = F.struct(*[c for c in named.columns if c not in ("group", "content", "times")])
    merged = named.groupBy("group", "content").agg(F.count("*").alias("n"), F.sum("times").alias("times"), F.first(rest).alias("x"))
    merged = stored(merged.select("group", "content", "n", "times", "x.*"), "merged-parts")
    equal = named.join(merged.where("n > 1").select("group", "content"), ["group", "content"]).select("key", "low", "high")
    kinds = stored(merged.groupBy("group").agg(F.count("*").alias("kinds")).where("kinds > 1"), "part-kinds")
    few = merged.join(kinds.where(f"kinds <= {common}"), "group")
    many = kinds.where(f"kinds > {common}")
    again = None if many.isEmpty() else merged.join(many, "group").select(*pieces.columns)
    return few, equal, again


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 common: int = COMMON) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every document: its UTF-8 bytes without each byte covered by a string
    of `length` bytes that also starts anywhere else, in the same document or another. `length` is a multiple of 8.

    Every start belongs to a run with one anchor, a half-length string chosen by content, so equal strings meet under
    equal anchors. Runs whose anchor is met once hold nothing repeated. Of the rest, runs of equal bytes are one piece
    with a count: all their starts repeat. Pieces that differ under one anchor are the edges of repeats: they are cut in
    two by where the anchor stands and gathered by three quarters of a string, and only these groups are sorted, as
    shards, by induced sorting; neighbours in that order with a long enough common prefix repeat. An anchor with more
    than `common` different pieces is divided further first, see `_divided`, so that no group grows with the corpus. A
    frequent passage costs some rows each time it occurs and no pairs. All strings are judged on the input. Null texts count as empty, and
    rows of equal id and text as different places.
    """
    half = length // 2
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    segments = stored(rows.select("key", "text").mapInArrow(lambda b: _segments(b, length), SEGMENT), "segments")
    known = segments.where("anchor IS NULL")
    segments = segments.where("anchor IS NOT NULL")
    shared = segments.groupBy("anchor").agg(F.count("*").alias("met")).where("met > 1").select("anchor")
    shared = stored(shared, "shared-anchors")  # read anew, so a common anchor's side of the join can be split
    segments = stored(segments.join(shared, "anchor"), "shared-segments")
    contents = segments.groupBy("anchor", "content").agg(
        F.sum("times").alias("times"), *[F.first(c).alias(c) for c in ("key", "first", "span", "off")]
    )
    contents = stored(contents, "contents")
    copies = segments.join(contents.where("times > 1").select("anchor", "content"), ["anchor", "content"])
    whole = copies.unionByName(known).select("key", F.col("first").alias("low"), (F.col("first") + F.col("span")).alias("high"))

    kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = stored(kinds, "kinds")
    held = rows.select("key", F.col("text").cast("binary").alias("raw"))

    def edges(anchors: DataFrame) -> DataFrame:
        """The differing runs of some anchors with their bytes, as pieces for `_parted`."""
        runs = contents.join(anchors.select("anchor"), "anchor").join(held, "key")
        return runs.select(
            F.col("anchor").alias("group"), "key", F.expr("first + off AS at"), F.col("first").alias("low"),
            F.expr("first + span AS high"), "times", F.lit(half - length).alias("a"), F.lit(0).alias("b"),
            F.expr(f"substring(raw, CAST(first AS INT) + 1, span + {length})").alias("piece"),
        )

    sortable = [_parted(edges(kinds.where(f"kinds <= {common}")), 2, length)]
    frequent = kinds.where(f"kinds > {common}")
    pieces = None if frequent.isEmpty() else edges(frequent)
    while pieces is not None:
        few, more, pieces = _divided(pieces, length, common)
        sortable.append(few)
        whole = whole.unionByName(more)
    shards = reduce(DataFrame.unionByName, [x.select("group", "key", "low", "times", "piece") for x in sortable])
    shards = shards.repartition("group").sortWithinPartitions("group")
    partial = shards.mapInArrow(lambda b: _sort_shards(b, length), "key long, low long, high long")

    spans = whole.unionByName(partial).groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    out = rows.select("key", "id", F.col("text").cast("binary").alias("raw")).join(spans, "key", "left")
    kind = dict(rows.dtypes)["id"]
    return out.select("id", "raw", "spans").mapInArrow(
        lambda b: _cut(b, length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    ).withColumnRenamed("id", id_col)
