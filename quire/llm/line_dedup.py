"""Line dedup: documents that share rare lines are aligned, and aligned common blocks leave the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.llm.common import POWERS, mixed, stored, utf8, words

MIN_WORDS = 3  # of a run of lines that proposes a partner, and of a block that is deleted
#: Scripts that set no blanks between words, with their marks.
UNSPACED = (
    r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    r"\u3001-\u303F\u30FC\uFF01-\uFF0F\uFF1A-\uFF1F\uFF5B-\uFF9F"
)
MIXED_WORD = regex.compile(rf"[{UNSPACED}]{{1,2}}|[^\x20\x09-\x0D{UNSPACED}]+")


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of every line of some texts, where two letters of a script without blanks are a word, and the
    line that each text begins with."""
    data, offsets = utf8(texts)
    feeds = np.flatnonzero(data == 10)
    # A text of n line feeds has n + 1 lines: the starts of texts and what follows the line feeds, in order.
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    first = np.searchsorted(feeds, offsets[:-1]) + np.arange(len(offsets) - 1)
    begins = words(data, offsets)[0]
    counts = np.diff(np.append(np.searchsorted(begins, starts), len(begins)))
    # Bytes from E0 on begin letters of three bytes or more; those of E2 up to B9 are signs.
    wide = data >= 0xE0
    wide[:-1] &= (data[:-1] != 0xE2) | (data[1:] >= 0xBA)
    ends = np.append(starts[1:], len(data))
    for i in np.unique(np.searchsorted(starts, np.flatnonzero(wide), "right") - 1).tolist():
        counts[i] = len(MIXED_WORD.findall(data[starts[i]:ends[i]].tobytes().decode()))
    return counts, first


def _anchors(a: list[int], b: list[int], window: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Positions of lines that occur once on both sides, in the longest order both agree on. Where no line does, the
    n-th occurrence on one side stands for the n-th on the other."""
    a0, a1, b0, b1 = window
    one, two = Counter(a[a0:a1]), Counter(b[b0:b1])
    single = {x for x, n in one.items() if n == 1 and two.get(x) == 1}
    if single:
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if x in single}
        pairs = [(at[x], j) for j, x in enumerate(b[b0:b1], b0) if x in single]
    else:
        places: dict[int, list[int]] = {}
        for i in range(a1 - 1, a0 - 1, -1):
            if a[i] in two:
                places.setdefault(a[i], []).append(i)
        pairs = [(places[x].pop(), j) for j, x in enumerate(b[b0:b1], b0) if places.get(x)]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for n, (i, _) in enumerate(pairs):
        k = bisect_left(tails, i)
        back[n] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(i)
            ends.append(n)
        else:
            tails[k], ends[k] = i, n
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal lines of two documents as positions, in order."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, (a0, a1, b0, b1))
        for i, j in anchors:
            out.append((i, j))
            work.append((a0, i, b0, j))
            a0, b0 = i + 1, j + 1
        if anchors:
            work.append((a0, a1, b0, b1))
    return sorted(out)


def runs_of(lines: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the shortest run of at least so many words from each line on, and of the shortest one up
    to each line of fewer words. The runs inside a block of that many words cover it. A line alone has its own hash."""
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    starts = np.arange(len(lines))
    ends = np.maximum(np.searchsorted(sums, sums[:-1] + least), starts + 1)
    last = np.flatnonzero(words < least) + 1
    first = np.searchsorted(sums, sums[last] - least, "right") - 1
    held, back = ends <= len(lines), first >= 0
    starts, ends = np.concatenate([starts[held], first[back]]), np.concatenate([ends[held], last[back]])
    own = lines.astype(np.int64).view(np.uint64)
    up, down = POWERS.to(len(lines) + 1)
    total = np.zeros(len(lines) + 1, np.uint64)
    np.cumsum((own + np.uint64(1)) * up[:-1], out=total[1:])
    several = mixed((total[ends] - total[starts]) * down[starts])
    return starts, ends, np.where(ends - starts == 1, own[starts], several).view(np.int64)


def _common_runs(earlier: list[int], later: list[int], words: list[int], least: int) -> list[int]:
    """Positions of the later lines in runs of at least so many words that the earlier lines have anywhere."""
    known = dict(zip(later, words, strict=True))
    one = runs_of(np.array(earlier, np.int64), np.array([known.get(x, 0) for x in earlier], np.int64), least)[2]
    starts, ends, two = runs_of(np.array(later, np.int64), np.array(words, np.int64), least)
    both = np.isin(two, one)
    inside = np.zeros(len(later) + 1, np.int64)
    np.add.at(inside, starts[both], 1)
    np.add.at(inside, ends[both], -1)
    return np.flatnonzero(np.cumsum(inside)[:-1] > 0).tolist()


def repeated_lines(earlier: list[int], later: list[int], words: list[int], least: int = MIN_WORDS) -> list[int]:
    """Positions of the later document's lines in blocks of at least so many words that the earlier one has.

    The documents are aligned once. What is left, passages in another order and blocks that short lines kept out of the
    alignment, is looked up by the hashes of its runs until nothing is found: a round costs what the lines left cost.
    """
    blocks: list[list[tuple[int, int]]] = []
    for i, j in patience(earlier, later):
        if blocks and blocks[-1][-1] == (i - 1, j - 1):
            blocks[-1].append((i, j))
        else:
            blocks.append([(i, j)])
    gone = [j for block in blocks if sum(words[j] for _, j in block) >= least for _, j in block]
    known = set(earlier)
    dropped = set(gone)
    left = [j for j in range(len(later)) if j not in dropped]
    while any(later[j] in known for j in left):
        found = [left[j] for j in _common_runs(earlier, [later[j] for j in left], [words[j] for j in left], least)]
        if not found:
            break
        gone += found
        dropped = set(found)
        left = [j for j in left if j not in dropped]
    return sorted(gone)


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines at some positions; null where the text is."""

    def cut(text: str | None, positions: np.ndarray | None) -> str | None:
        if text is None or positions is None:
            return text
        dropped = set(positions.tolist())
        return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in dropped])

    return pd.Series([cut(x, p) for x, p in zip(texts, gone, strict=True)], dtype=object)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, the text without deleted lines, and n_lines and n_removed.

    Two documents are a pair when the later (greater id, then greater hash of the text) has a run of lines of at least
    `min_words` words whose first document is the other. Runs are the shortest ones from each line on, and up to each
    line of fewer words; a line of enough words is a run, and every block that may be deleted has runs that cover it. A
    run that only one document has proposes nothing; however common a run, it proposes one partner for each document
    that has it, so nothing need be capped and pairs grow with the lines. Pairs are aligned by patience diff; equal
    lines side by side form blocks, and those of at least `min_words` words are deleted from the later document. Lines
    end at line feeds and are compared whole, by hash. Two letters of a script without blanks count as a word.
    Repeats inside one document stay. Rows equal in id and text are one document. Null texts stay null, with no line.
    Rows of a null id come back as they are: they have no place in the order of documents. n_chars, where there is such
    a column, is counted anew.
    """
    lines = F.split(F.col("text"), "\n")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    kind = dict(rows.dtypes)["id"]
    doc = F.struct(F.col("id"), F.xxhash64("text").alias("h")).alias("doc")
    hashed = rows.where("id IS NOT NULL").select(doc, F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, first = line_words(batch.column(2))
            counted = pa.ListArray.from_arrays(pa.array(np.append(first, len(counts)), pa.int32()), pa.array(counts, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counted], names=["doc", "lines", "words"])

    held = hashed.mapInArrow(count, f"doc struct<id: {kind}, h: bigint>, lines array<bigint>, words array<int>")
    held = stored(held.dropDuplicates(["doc"]), "line-hashes")  # joined below as read, so a common document's side can be split

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).flatten().to_numpy() for i in (1, 2)]
            at = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(), dtype=np.int64)])
            found = []
            for s, e in zip(at[:-1], at[1:], strict=True):
                found.append(np.unique(runs_of(columns[0][s:e], columns[1][s:e], min_words)[2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc", "runs"])

    runs = held.select("doc", "lines", "words").mapInArrow(propose, f"doc struct<id: {kind}, h: bigint>, runs array<bigint>")
    probes = runs.select("doc", F.explode("runs").alias("line"))
    firsts = probes.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    firsts = stored(firsts.select("line", "first"), "first-documents")  # read anew, so a common line's side can be split
    pairs = probes.join(firsts, "line").where("doc > first").select("doc", "first").distinct()
    work = pairs.join(held, "doc").join(held.select(F.col("doc").alias("first"), F.col("lines").alias("earlier")), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, 4)]
            gone = [repeated_lines(e, l, w, min_words) for e, l, w in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["doc", "gone"])

    found = work.select("doc", "earlier", "lines", "words").mapInArrow(run, f"doc struct<id: {kind}, h: bigint>, gone array<int>")
    found = found.where(F.size("gone") > 0).groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    found = found.select(F.col("doc.id").alias("id"), F.col("doc.h").alias("h"), "gone").alias("f")
    out = docs.alias("d").join(found, (F.col(f"d.`{id_col}`") == F.col("f.id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("f.h")), "left")
    untouched = F.col("f.gone").isNull()
    text = F.col(f"d.`{text_col}`")
    text = F.when(untouched, text).otherwise(_without(F.when(~untouched, text), F.col("f.gone")))
    out = out.select(
        *[text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col(f"d.`{text_col}`").isNull(), 0).otherwise(F.size(F.split(F.col(f"d.`{text_col}`"), "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("f.gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
