"""Quality classifier: supervised embeddings of hashed words, word pairs and character n-grams, averaged by document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mixed, runs, span_hashes, stored, utf8, words

#: The score from which a document counts as good.
KEPT_FROM = 0.3


@dataclass(frozen=True)
class Settings:
    """Of the model. `sample` bounds the labelled rows of each class that train it, taken by seeded hash."""

    sample: int = 1500
    buckets_log2: int = 17
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 4
    rate: float = 0.4
    seed: int = 5


def features(data: np.ndarray, offsets: np.ndarray, at: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The feature families of a run of rows, each as (buckets, first feature of each row): byte n-grams within a row,
    words, and pairs of neighbouring words. Equal neighbours share one pair, whatever the word."""
    shift = np.uint64(64 - at.buckets_log2)
    wide = data.astype(np.uint64)
    for n in at.grams:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = wide[:m].copy()
        for k in range(1, n):
            h |= wide[k : m + k] << np.uint64(8 * k)
        buckets = ((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
        whole = np.ones(m + n, dtype=bool)
        for k in range(1, n):
            whole[offsets[1:-1] - k] = False  # would reach into the next row
        kept = np.flatnonzero(whole[:m])
        yield buckets[kept].astype(np.int32), np.searchsorted(kept, offsets)
    begin, end, first = words(data, offsets)
    h = span_hashes(data, begin, end)
    yield (h >> shift).astype(np.int32), first
    row = np.searchsorted(first, np.arange(len(h)), "right")
    pairs = np.flatnonzero(row[1:] == row[:-1])
    yield (mixed(h[pairs] ^ h[pairs + 1]) >> shift).astype(np.int32), np.searchsorted(pairs, first)


def _vectors(texts: list[str], at: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text as sorted buckets and weights; every family of features is averaged, and the families added up."""
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        ids, weights = [], []
        for buckets, _ in features(data, np.array([0, len(data)]), at):
            if len(buckets):
                ids.append(buckets)
                weights.append(np.full(len(buckets), 1 / len(buckets), np.float32))
        if not ids:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        kinds, place = np.unique(np.concatenate(ids), return_inverse=True)
        out.append((kinds, np.bincount(place, np.concatenate(weights)).astype(np.float32)))
    return out


def train(texts: list[str], labels: np.ndarray, at: Settings) -> np.ndarray:
    """One number per bucket and the bias last: the weight of a bucket's vector in favour of label 1.

    Stochastic gradient descent on softmax loss over the input vectors and the output matrix. A document's step is
    divided by the square of its weights, so that its own vector moves by the rate whatever its length.
    """
    rng = np.random.default_rng(at.seed)
    size = 1 << at.buckets_log2
    inputs = rng.uniform(-1, 1, (size, at.dim)).astype(np.float32) / at.dim
    output = rng.normal(0, 0.1, (2, at.dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    vectors = _vectors(texts, at)
    steps, total = 0, at.epochs * len(texts)
    for _ in range(at.epochs):
        for i in rng.permutation(len(texts)):
            ids, weights = vectors[i]
            rate = at.rate * (1 - steps / total)
            steps += 1
            hidden = weights @ inputs[ids]
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = output.T @ p
            output -= rate * np.outer(p, hidden)
            bias -= np.float32(rate) * p
            if len(ids):
                inputs[ids] -= np.outer(weights * np.float32(rate / float(weights @ weights)), back)
    return np.append(inputs @ (output[1] - output[0]), bias[1] - bias[0]).astype(np.float32)


def score_batch(column: pa.Array, model: np.ndarray, at: Settings) -> np.ndarray:
    """The probability of label 1 for every text of a batch."""
    data, offsets = utf8(column)
    out = np.zeros(len(column))
    for a, b in runs(offsets, 1 << 19):
        own = offsets[a : b + 1] - offsets[a]
        for buckets, first in features(data[offsets[a] : offsets[b]], own, at):
            sums = np.concatenate([[0.0], np.cumsum(model[buckets], dtype=np.float64)])
            out[a:b] += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))
    return 1 / (1 + np.exp(-(out + float(model[-1]))))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """A model from the documents whose labels may be learnt: not held out, quality 0 or 1, the first `sample` of each
    class by seeded hash of the id. Repeated ids, null labels and labels without a document add nothing wrong: an id
    counts once, with its largest label. The bounded sample is trained in one task; the model, half a megabyte, is
    what comes back. Without labels of both classes the model knows nothing and scores 0.5."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = [F.xxhash64(F.lit(settings.seed), "doc_id"), F.col("doc_id")]
    chosen = [usable.where(F.col("quality") == q).orderBy(*order).limit(settings.sample) for q in (0, 1)]
    sample = stored(chosen[0].union(chosen[1]), "labelled-ids")
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    held = stored(held, "labelled").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        model = train(pdf["text"].tolist(), pdf["quality"].to_numpy(), settings) if pdf["quality"].nunique() == 2 else None
        return pd.DataFrame({"model": [] if model is None else [model.tobytes()]})

    rows = held.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return np.frombuffer(rows[0]["model"], np.float32) if rows else np.zeros((1 << settings.buckets_log2) + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray, text_col: str = "text", settings: Settings = Settings(),
          score_col: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1, higher where label 1 is likelier, from whole texts alone.

    Null and empty texts get the score of the bias. Other columns pass through; one named like the score is replaced.
    """
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score_batch(batch.column(text_col), shared.value, settings)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, schema)
