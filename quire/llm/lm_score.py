"""Language-model scoring: stupid backoff over n-gram counts of the whole corpus, joined to every document's n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, mixed, runs, span_hashes, stored, utf8, words

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2  # of n-grams of two words or more; rarer ones are left out of the tables
KEY_BITS = 56  # of an n-gram's hash
CHUNK = 8 << 20  # bytes of text whose n-grams are looked up together
PART = 8 << 20  # bytes of text for each partition of the tables


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 1 to `order` the key of the n-gram that ends at each word, and the number of words before each row.
    An n-gram that would begin before its row has the key of no n-gram: all bits set beyond KEY_BITS."""
    hashes, counts = [], [np.zeros(1, np.int64)]
    for a, b in runs(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        begin, end, first = words(part, offsets[a : b + 1] - offsets[a])
        hashes.append(span_hashes(part, begin, end))
        counts.append(np.diff(first))
    first = np.cumsum(np.concatenate(counts))
    word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    place = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))
    keys, last = [], word
    for n in range(1, order + 1):
        if n > 1:
            last = mixed(np.concatenate([last[:1], last[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(n))
        key = last >> np.uint64(64 - KEY_BITS)
        keys.append(np.where(place >= n - 1, key, ~np.uint64(0)))
    return keys, first


def _real(keys: np.ndarray) -> np.ndarray:
    return keys[keys != ~np.uint64(0)]


def packed(keys: np.ndarray, base: int) -> tuple[bytes, int]:
    """Sorted keys as differences of as many bytes as the largest needs, bytes of one weight together."""
    gaps = np.diff(keys, prepend=np.uint64(base))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True), width


def unpacked(data: bytes, width: int, n: int, base: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return np.cumsum(wide.view(np.uint64).ravel()) + np.uint64(base)


def small(numbers: np.ndarray) -> tuple[int, bytes, bytes]:
    """Numbers as how many, a byte each, and in full those that a byte cannot hold."""
    low = np.minimum(numbers, 255).astype(np.uint8)
    return len(low), pa.compress(low.tobytes(), "zstd", asbytes=True), numbers[low == 255].astype(np.int64).tobytes()


def restored(n: int, low: bytes, high: bytes) -> np.ndarray:
    out = np.frombuffer(pa.decompress(low, n, "zstd", asbytes=True), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(high, np.int64)
    return out


COUNTS = [("length", pa.int64()), ("low", pa.binary()), ("high", pa.binary())]
ASKED = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("width", pa.int32()), *COUNTS])
TOLD = pa.schema([("chunk", pa.int32()), ("n", pa.int32()), ("part", pa.int32()), *COUNTS])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF,
          min_count: int = MIN_COUNT) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) for every document, by counts over all documents.

    A word's score is c(n-gram) / c(its first n - 1 words) for the longest n-gram of up to `order` words ending there
    that the tables have; each step down from the longest that the document's start allows costs a factor `backoff`,
    and single words score c(word) / N. n-grams of two or more words that occur fewer than `min_count` times are not in
    the tables. Words are split at white space after A-Z are lower-cased, and never run over documents. The logs are
    summed per document. Texts without words (null, empty, blank) have log_score 0 and no mean. Ids may repeat; rows
    whose id is null or no number are dealt to chunks by their text.

    Documents are taken in chunks of consecutive ids. A chunk sends each n-gram once, with its count, to the partition
    that its hash belongs to; there the counts are added up, and every chunk gets the totals of its own n-grams back,
    packed in the order of their keys. A common n-gram costs a row entry per chunk, however often it occurs, and the
    count tables never leave their partitions.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks, bits = size // CHUNK + 1, int(size // PART).bit_length()
    shift = np.uint64(KEY_BITS - bits)
    chunk = F.lit(0)
    if n_chunks > 1:
        place = F.col("id").cast("string").try_cast("double")
        cuts = rows.select(place.alias("id")).approxQuantile(
            "id", [i / n_chunks for i in range(1, n_chunks)], 1 / (4 * n_chunks)
        )
        held = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
        chunk = F.when(place.isNull(), F.pmod(F.xxhash64("text"), F.lit(n_chunks))).otherwise(
            F.size(F.filter(held, lambda c: c <= place))
        )
    rows = rows.withColumn("chunk", chunk.cast("int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = np.array(batch.column(0))
            for own in np.unique(chunks).tolist():
                data, offsets = utf8(batch.column(1).take(pa.array(np.flatnonzero(chunks == own))))
                out = []
                for n, keys in enumerate(grams(data, offsets, order)[0], 1):
                    kinds, counts = np.unique(_real(keys), return_counts=True)
                    cut = np.searchsorted(kinds >> shift, np.arange((1 << bits) + 1).astype(np.uint64))
                    for part in range(1 << bits):
                        a, b = cut[part], cut[part + 1]
                        if a < b:
                            out.append((part, own, n, *packed(kinds[a:b], part << int(shift)), *small(counts[a:b])))
                yield from _table(out, ASKED).to_batches()

    def tell(asked: pa.Table) -> pa.Table:
        rows, out = asked.to_pylist(), []
        for n in sorted({r["n"] for r in rows}):
            own: dict[int, list[np.ndarray]] = {}
            counts = []
            for r in (r for r in rows if r["n"] == n):
                keys = unpacked(r["keys"], r["width"], r["length"], r["part"] << int(shift))
                own.setdefault(r["chunk"], []).append(keys)
                counts.append((r["chunk"], restored(r["length"], r["low"], r["high"])))
            by_chunk: dict[int, list[np.ndarray]] = {}
            for c, x in counts:
                by_chunk.setdefault(c, []).append(x)
            keys = np.concatenate([k for c in own for k in own[c]])
            order_ = np.argsort(keys)
            keys = keys[order_]
            weights = np.concatenate([x for c in own for x in by_chunk[c]])[order_].astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            kinds, totals = keys[starts], np.add.reduceat(weights, starts)
            if n > 1:
                totals[totals < min_count] = 0
            for c, parts in own.items():
                mine = np.unique(np.concatenate(parts))
                out.append((c, n, rows[0]["part"], *small(totals[np.searchsorted(kinds, mine)])))
        return _table(out, TOLD)

    kind = dict(rows.dtypes)["id"]
    result_schema = f"id {kind}, n_words long, n_single long, log_part double"

    def add_up(own: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets = utf8(own.column("text"))
        keys, first = grams(data, offsets, order)
        found: list[np.ndarray] = []
        by_order: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in told.to_pylist():
            by_order.setdefault(r["n"], []).append((r["part"], restored(r["length"], r["low"], r["high"])))
        for n, key in enumerate(keys, 1):
            real = key != ~np.uint64(0)
            counts = np.zeros(len(key), np.int64)
            if real.any():
                _, place = np.unique(key[real], return_inverse=True)
                totals = np.concatenate([x for _, x in sorted(by_order[n], key=lambda p: p[0])])
                counts[real] = totals[place]
            found.append(counts)
        at = np.arange(len(keys[0])) - np.repeat(first[:-1], np.diff(first))
        value, open_ = np.zeros(len(at)), np.ones(len(at), bool)
        for n in range(order, 1, -1):
            context = np.concatenate([[0], found[n - 2][:-1]])
            hit = open_ & (at >= n - 1) & (found[n - 1] > 0)
            steps = np.minimum(order, at + 1) - n
            value[hit] = np.log(found[n - 1][hit] / context[hit]) + steps[hit] * np.log(backoff)
            open_ &= ~hit
        steps = np.minimum(order, at + 1) - 1
        value[open_] = np.log(found[0][open_]) + steps[open_] * np.log(backoff)
        sums, singles = (np.concatenate([[0], np.cumsum(x)]) for x in (value, open_))
        columns = [own.column("id"), np.diff(first), singles[first[1:]] - singles[first[:-1]], sums[first[1:]] - sums[first[:-1]]]
        return pa.table(columns, names=["id", "n_words", "n_single", "log_part"])

    asked = rows.select("chunk", "text").mapInArrow(
        ask, "part int, chunk int, n int, keys binary, width int, length long, low binary, high binary"
    )
    told = asked.groupBy("part").applyInArrow(tell, "chunk int, n int, part int, length long, low binary, high binary")
    parts = rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(add_up, result_schema)
    parts = stored(parts, "log-scores")
    total = parts.agg(F.sum("n_words")).first()[0] or 1
    log_score = F.col("log_part") - F.col("n_single") * F.lit(float(np.log(total)))
    return parts.select(
        F.col("id").alias(id_col), "n_words", log_score.alias("log_score"),
        F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"),
    )
