"""Mixing sources to target weights: exact word budgets filled from counts of documents by length."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import GAP, fresh, stored

SLICES = 256  # parts in which the documents of one source and length are ranked
MAX_REPEATS = 3
RESERVE = 4096  # words that the knapsack fits


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    held = F.length(F.regexp_replace(text, GAP, "")) > 0
    trimmed = F.regexp_replace(F.regexp_replace(text, f"^{GAP}", ""), f"{GAP}$", "")
    return F.when(held, F.size(F.split(trimmed, GAP))).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) for one row per source (source, source_size).

    The weights go to the sources by code point, null last, over and over. Target = min(level * weight, repeats * size)
    with the one level at which the targets sum to all sizes: what the filled sources cannot take is reshared by weight.
    One row per source passes through one window; documents never do.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", pick[(F.row_number().over(order) - 1) % len(weights)])
    w = w.withColumn("most", F.lit(float(repeats)) * F.col("source_size"))
    w = w.withColumn("fill", F.col("most") / F.col("weight"))
    filled = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    w = w.withColumn("taken_before", F.coalesce(F.sum("most").over(filled), F.lit(0.0)))
    w = w.withColumn(
        "weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    )
    # The sources that fill first are those whose level, were they all still open, passes their own bound.
    level = (F.col("total") - F.col("taken_before")) / F.col("weight_left")
    w = w.withColumn("level", F.max(F.when(level <= F.col("fill"), level)).over(everything))
    target = F.least(F.col("weight") * F.col("level"), F.col("most"))
    return w.select("source", "source_size", F.coalesce(target, F.col("most")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near as possible to the budget.

    Every length first gives the budget's share of its documents, rounded down. Further documents, longest first, are
    added while more than a reserve stays open; the reserve is met by a bounded knapsack over the documents left: bit s
    of a number says whether sum s can be reached.
    """
    size = int((lengths * counts).sum())
    if budget >= size:
        return counts.copy()
    taken = (counts.astype(object) * budget // size).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        more = min(int(counts[i] - taken[i]), max(0, left - RESERVE) // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    items: list[tuple[int, int]] = []
    for i in order[::-1]:
        free, part = min(int(counts[i] - taken[i]), 2 * left // int(lengths[i])), 1
        while free > 0:
            part = min(part, free)
            items.append((int(i), part))
            free, part = free - part, part * 2
    most = 2 * left  # beyond it, taking nothing is nearer
    keep = (1 << (most + 1)) - 1
    reach, steps = 1, []
    for i, part in items:
        grown = (reach | (reach << (part * int(lengths[i])))) & keep
        if grown != reach:
            steps.append((i, part, reach))
            reach = grown
        if reach >> left & 1:
            break
    at = left
    for gap in range(most + 1):
        if gap <= left and reach >> (left - gap) & 1:
            at = left - gap
            break
        if reach >> (left + gap) & 1:
            at = left + gap
            break
    for i, part, had in reversed(steps):
        if not had >> at & 1:
            at -= part * int(lengths[i])
            taken[i] += part
    return taken


def _plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of every document, and how many documents of each length get one more."""
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    size = int((lengths * counts).sum())
    budget = int(round(pdf["target"].iloc[0]))
    whole, rest = divmod(budget, size) if size else (0, 0)
    extra = np.zeros(len(counts), np.int64)
    words = lengths > 0
    if rest:
        extra[words] = fit(lengths[words], counts[words], rest)
    return pd.DataFrame(
        {"source": pdf["source"], "size": lengths, "copies": np.where(words, whole, 1), "extra": extra}
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (1, 2, 3), repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """(id, source, row_hash, size, source_size, target, copies, taken): how often the mix takes every document.

    Lengths are counted exactly; a source's budget goes to whole passes over it and a subset fitted by length, and
    within a length the documents with the least seeded hashes are taken, so reruns agree. Documents of one source and
    length are ranked in 256 slices of the hash, so a source of equal documents is no single group. Counts by length
    are aggregated before any shuffle; one source's counts, not its documents, meet in one task.
    A null text has size 0. Documents without words are taken once and count nothing. A null source is a source.
    Rows with equal id and text tie; they are told apart by their count only, so either may be the one taken more often.
    """
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("row_hash"),
        ).withColumn("slice", F.pmod(F.col("row_hash"), F.lit(SLICES)).cast("int")),
        "sizes",
    )
    by_slice = rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    by_length = stored(by_slice.groupBy("source", "size").agg(F.sum("n").alias("n")), "lengths")
    sizes = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = stored(targets(sizes, weights, repeats), "targets")
    told = by_length.alias("l").join(goal.alias("g"), F.expr("l.source <=> g.source")).select(
        "l.source", "l.size", "l.n", "g.target"
    )
    plan = told.groupBy("source").applyInPandas(_plan, "source string, size long, copies long, extra long")
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ranked = Window.partitionBy("source", "size", "slice").orderBy("row_hash", "id")
    starts = by_slice.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    starts = starts.alias("s").join(plan.alias("p"), F.expr("s.source <=> p.source AND s.size = p.size")).select(
        "s.source", "s.size", "s.slice", "s.before", "p.copies", "p.extra"
    )
    rows = rows.withColumn("rank", F.row_number().over(ranked))
    out = rows.alias("r").join(
        starts.alias("s"), F.expr("r.source <=> s.source AND r.size = s.size AND r.slice = s.slice")
    ).join(goal.alias("g"), F.expr("r.source <=> g.source"))
    copies = F.col("s.copies") + (F.col("s.before") + F.col("r.rank") <= F.col("s.extra")).cast("long")
    return out.select(
        "r.id", "r.source", "r.row_hash", "r.size", "g.source_size", "g.target", copies.alias("copies"),
        (copies * F.col("r.size")).alias("taken"),
    )


EACH = 4096  # copies that one row is repeated into


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, **options) -> DataFrame:
    """The documents as the mix takes them, repeats as repeated rows, with the columns they had.

    Rows equal in id and text are taken equally often; what is then left over, fewer copies than there are such rows, is
    taken of one of them. So the mix has as many rows of each text as `mix` says.
    """
    choice = mix(docs, id_col=id_col, text_col=text_col, seed=seed, **options).groupBy("row_hash", "id").agg(
        F.sum("copies").alias("all_copies"), F.count("*").alias("same")
    )
    choice = stored(choice.selectExpr("row_hash", "id", "all_copies div same AS each", "all_copies % same AS rest"), "choice")
    key = fresh(docs.columns, "key")
    held = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).alias("d").join(
        choice.alias("c"), (F.col(f"d.`{key}`") == F.col("c.row_hash")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col("c.id"))
    )
    row = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row")
    whole = held.where("c.each > 0").select(row, F.explode(F.expr("sequence(1, c.each)")))
    one = held.where("c.rest > 0").groupBy("c.row_hash", "c.id").agg(F.first(row).alias("row"), F.first("c.rest").alias("rest"))
    parts = one.select("row", "rest", F.explode(F.expr(f"sequence(0, rest - 1, {EACH})")).alias("at"))
    more = parts.repartition("at").select("row", F.explode(F.expr(f"sequence(at, least(at + {EACH}, rest) - 1)")))
    return whole.select("row").union(more.select("row")).select("row.*")
