"""Hard negatives against whole score matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives
from quire.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, anchor long, score int, tile string"


def brute(rows):
    """The contract's rows from (vec_id, embedding, label), labels as given."""
    held = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), c) for i, v, c in rows
            if i is not None and v is not None and c is not None and len(v) and None not in v and np.isfinite(v).all()]
    out = []
    for i, a, c in (r for r in held if r[0] % 100 == 0):
        scores = [(-int(a @ v), j, k) for j, v, k in held if len(v) == len(a)]
        positives = sorted((s, j) for s, j, k in scores if k == c and j != i)[:5]
        others = sorted((s, j) for s, j, k in scores if k != c)
        for p, j in positives:
            fit = [(s, n) for s, n in others if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def shifted(rows):
    return [(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_all_scores(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, path).collect())
    assert got and got == brute(shifted(rows))


def planted():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 24))
    rows = [(i, (centres[i % 9] + rng.normal(size=24) * 0.3).tolist(), int(rng.integers(0, 4))) for i in range(1500)]
    rows += [(3000 + i, rows[17][1], i % 2) for i in range(400)]  # many equal vectors
    rows += [(i, np.zeros(24).tolist(), 1) for i in range(5000, 5100, 10)]
    return rows


def test_clusters_copies_and_small_tiles(spark):
    rows = planted()
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    for tile in (64, 700, 10**6):
        got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, tile=tile)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), i % 3) for i in range(0, 900, 20)]
    rows += [(i, rng.normal(size=3).tolist(), i % 3) for i in range(1000, 1900, 20)]
    rows += [(100, None, 1), (200, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (300, [float("nan")] * 6, 1), (400, [float("inf")] * 6, 0)]
    rows += [(None, rows[0][1], 1), (500, rows[1][1], None), (600, [], 1), (700, [1e4] * 6, 2), (701, [1e4] * 6, 1), (702, [-1e4] * 6, 1)]
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, tile=16)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    twice = hard_negatives.hard_negatives(frame.union(frame.where("vec_id = 100")), F.col("vec_id") % 100 == 0)
    assert {tuple(r) for r in twice.where("anchor_id = 0").collect()}
    none = hard_negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 100 == 0)
    assert none.count() == 0 and none.columns == got.columns
    assert hard_negatives.hard_negatives(frame.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_bitmap_shrinks_before_all_dimensions_are_read():
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.integers(-3, 4, size=(900, 32)), rng.integers(80, 120, size=(30, 32))])
    labels = np.repeat([0, 1], [900, 30])
    row = {"dims": 32, "ids": np.arange(930).tobytes(), "labels": labels.tobytes(),
           "columns": np.ascontiguousarray(rows.T.astype(np.int16)).tobytes()}
    tile = hard_negatives.Tile.open(row, 200)
    anchor = np.full(32, 100)
    ids, scores = hard_negatives.best(anchor, -1, 1, tile, 5)
    want = sorted((-int(anchor @ v), i) for i, v in enumerate(rows) if labels[i] == 1)[:5]
    assert [(-s, i) for s, i in zip(scores, ids, strict=True)] == want
    seen = []
    original = hard_negatives.scan

    def watched(*args):
        narrow = args[-1]
        return original(*args[:-1], lambda s, low, high: (seen.append(len(s)), narrow(s, low, high))[1])

    hard_negatives.scan = watched
    try:
        assert not hard_negatives.within(anchor, 1, np.array([[10**5, 2 * 10**5]]), tile, 5)
    finally:
        hard_negatives.scan = original
    assert len(seen) < 4 and seen[0] == 900
