"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 64  # characters of a leaf
SECTION = 8  # about so many paragraphs make a section
SHOWN = 8  # hexadecimal digits of a leaf in a fingerprint
LAST = (1 << 63) - 1


def _hash(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def fingerprint(text: str | None) -> str:
    """The tree of a text: its root, a colon, then the leaves; a dot ends a paragraph and a slash a section.

    Paragraphs are lines, cut from their start into leaves of 64 characters. A section ends with a paragraph whose
    digest says so, so that sections after an inserted paragraph stay the same. Every node hashes its children, the
    root over 128 bits: equal texts, and they alone, have equal roots. A null text counts as empty.
    """
    sections: list[bytes] = []
    own: list[bytes] = []
    shown: list[str] = []
    for line in (text or "").split("\n"):
        raw = [line[i : i + PIECE].encode("utf-8", "surrogatepass") for i in range(0, len(line), PIECE)]
        leaves = [_hash(x) for x in raw]
        own.append(_hash(b"".join(leaves)))
        shown.append("".join([x.hex()[:SHOWN] for x in leaves]))
        if own[-1][0] < 256 // SECTION:
            sections.append(_hash(b"".join(own)))
            own = []
            shown.append("/")
        else:
            shown.append(".")
    sections.append(_hash(b"s" + b"".join(own)))
    return f"{_hash(b''.join(sections), 16).hex()}:{''.join(shown)}"


def _sections(tree: str) -> list[str]:
    return tree.split(":", 1)[1].split("/")


def _leaves(paragraph: str) -> list[str]:
    return [paragraph[i : i + SHOWN] for i in range(0, len(paragraph), SHOWN)]


def _unmatched(mine: list[str], other: list[str]) -> tuple[list[str], list[str]]:
    """What each list has beyond the other, repeats counted."""
    a, b = Counter(mine), Counter(other)
    return list((a - b).elements()), list((b - a).elements())


def likeness(one: str, two: str) -> float:
    """The share of leaves that two fingerprints have in common, 0 to 1: twice those both have by those of both.

    Equal roots end it. Otherwise only branches that differ are opened: sections, their paragraphs, their leaves.
    Two trees without leaves are alike by their paragraphs' number alone.
    """
    if one.split(":", 1)[0] == two.split(":", 1)[0]:
        return 1.0
    total = sum(len(x.split(":", 1)[1].replace("/", "").replace(".", "")) // SHOWN for x in (one, two))
    if not total:
        return 0.0
    a, b = _unmatched(_sections(one), _sections(two))
    a, b = _unmatched([p for s in a for p in s.split(".")], [p for s in b for p in s.split(".")])
    a, b = _unmatched([x for p in a for x in _leaves(p)], [x for p in b for x in _leaves(p)])
    return 1 - (len(a) + len(b)) / total


@dataclass(frozen=True)
class Edit:
    """A range of leaves of the second text, in characters from its paragraph's start, that the first has not there."""

    paragraph: int
    start: int
    end: int


def edits(one: str, two: str) -> list[Edit]:
    """Where the second text differs: its leaves not met at the same place, or in an equal paragraph, of the first."""
    if one.split(":", 1)[0] == two.split(":", 1)[0]:
        return []
    first, second = (x.split(":", 1)[1].replace("/", ".").split(".")[:-1] for x in (one, two))
    known, found = set(first), []
    for n, paragraph in enumerate(second):
        if paragraph in known:
            continue
        old = _leaves(first[n]) if n < len(first) else []
        new = _leaves(paragraph)
        bad = [i for i, x in enumerate(new) if i >= len(old) or old[i] != x]
        if bad or not new:
            found.append(Edit(n, bad[0] * PIECE if bad else 0, (bad[-1] + 1) * PIECE if bad else 0))
    return found


def tail_edit(text: str, following: str) -> str:
    """A text whose last quarter of characters is replaced by the first as many of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = (
    "{id} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _chain(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows in order, each told by the one after it; a bucket's last row is only there to be followed to."""
    held: tuple | None = None
    kind: pa.DataType | None = None
    for batch in batches:
        kind = batch.schema.field(2).type
        out: list[tuple] = []
        for bucket, halo, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            tree = fingerprint(text)
            if held and held[0] == bucket:
                edited = tail_edit(held[2], text)
                new = fingerprint(edited)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((held[1], len(held[2]), digest, held[3], new, likeness(held[3], new), likeness(held[3], tree)))
            held = None if halo else (bucket, doc, text, tree)
            if len(out) >= 500:
                yield _batch(out, name, kind)
                out = []
        if out:
            yield _batch(out, name, kind)


def _batch(rows: list[tuple], name: str, kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [name, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [fingerprint(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], names=[id_col, "fingerprint"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to both that and the next document.

    The next document is the one of the next greater integer id; after the last comes the first, and a lone document
    follows itself. Rows of equal id stand in the order of their texts, null ids last. The ids are cut into ranges at
    quantiles; the first row of each range also goes to the range before it, so each range is worked through alone, in
    order, a row at a time, and texts are shuffled once. What is broadcast is one id for each range.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(LAST)).alias("key"), F.col(text_col).alias("text"))
    cuts = rows.select(F.col("key").cast("double").alias("key")).approxQuantile(
        "key", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)
    )
    bucket = F.lit(0)
    if cuts:
        held = F.array(*[F.lit(c) for c in sorted(set(cuts))])
        bucket = F.size(F.filter(held, lambda c: c <= F.col("key").cast("double")))
    rows = rows.withColumn("bucket", bucket)
    rows, firsts = _with_firsts(rows)
    halo = rows.alias("r").join(F.broadcast(firsts).alias("f"), F.expr("r.key = f.key")).groupBy("f.to").agg(
        F.min_by(F.struct("r.id", "r.key"), F.coalesce("r.text", F.lit(""))).alias("at"),
        F.min(F.coalesce("r.text", F.lit(""))).alias("text"),
    )
    followed = rows.select("bucket", F.lit(0).alias("halo"), "id", "text", "key").unionByName(
        halo.select(F.col("to").alias("bucket"), F.lit(1).alias("halo"), F.col("at.id").alias("id"), "text", F.col("at.key").alias("key"))
    )
    order: list[str | Column] = ["bucket", "halo", "key", F.coalesce("text", F.lit(""))]
    laid = followed.repartition(ranges, "bucket").sortWithinPartitions(*order).select("bucket", "halo", "id", "text")
    kind = dict(docs.dtypes)[id_col]
    return laid.mapInArrow(lambda batches: _chain(batches, id_col), SCHEMA.format(id=f"`{id_col}`", kind=kind))


def _with_firsts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and for each range its least key with the range before it, the last one before the first."""
    least = rows.groupBy("bucket").agg(F.min("key").alias("key"))
    order = Window.orderBy("bucket")  # one row for each range
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    return rows, least.select("key", before.alias("to"))
