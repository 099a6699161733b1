import math
import os
from datetime import date

import numpy as np
import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.operators.bounded import files_to_read, prompt_search_bounded, search_by_example_bounded, search_bounded
from quire.operators.retrieval import prompt_search, search_by_example, search_stored
from quire.sources import bounds
from quire.sources.bounds import add_bounds, bounded_files, file_of, lake_bounds, measured
from quire.sources.lake import lake_files, lake_scan, write_lake
from tests.test_retrieval import SCHEMA

DAYS = 20


def topic_rows(n, seed, mark="c"):
    """Vectors near one direction a day, so that files differ in direction; some days hold opposite ones too."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(DAYS, 16))
    rows = []
    for i in range(n):
        day = i % DAYS
        vector = centres[day] * (-1 if day == 3 and i % 2 else 1) + rng.normal(size=16) * 0.1
        filed = date(2024, 3, day + 1)
        domain = ("finance", "a+b %:x")[day % 2]
        rows.append((f"{mark}{i:05d}", f"d{i}", domain, "a.htm", "10-K", filed, "Item 1", i % 3 == 0, f"text {i}", [float(v) for v in vector], "{}"))
    return rows


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake") / "my lake+1")
    write_lake(spark.createDataFrame(topic_rows(2000, 5), SCHEMA), root)
    add_bounds(spark, root, block=30)
    return root


def sets(df):
    """Rows in any order; the last digits of a score depend on the batch it was computed in."""
    scores = {c: F.round(c, 9) for c in df.columns if c == "similarity_score"}
    return sorted(map(str, df.withColumns(scores).collect()))


def test_no_vector_exceeds_the_bound_of_its_file(spark, root):
    rng = np.random.default_rng(2)
    for query in ([float(v) for v in rng.normal(size=16)], topic_rows(4, 9)[3][9]):
        lake = lake_scan(spark, root).select(file_of(F.col("_metadata.file_path")).alias("file"), "embedding")
        best = {}
        for row in lake.collect():
            v, q = np.array(row["embedding"], dtype=float), np.array(query)
            best[row["file"]] = max(best.get(row["file"], -2), v @ q / np.linalg.norm(v) / np.linalg.norm(q))
        bound = {row["file"]: row["bound"] for row in bounded_files(spark, root, query).collect()}
        assert set(bound) == set(best) and len(best) >= DAYS
        assert all(best[f] <= bound[f] < math.inf for f in best)


@pytest.mark.parametrize(
    "options",
    [{}, {"domain": None, "k": 7}, {"domain": " A+b %:X", "k": 40}, {"is_table_only": True}, {"similarity_threshold": 0.99}, {"k": 5000, "domain": None}],
)
def test_hits_are_those_of_the_full_search(spark, root, options):
    stored = lake_scan(spark, root)
    for query in (topic_rows(DAYS, 11)[2][9], [1.0] * 16 if options else [0.0] * 16):
        assert sets(search_bounded(spark, root, query, seeds=2, **options)) == sets(search_stored(stored, query, **options))


def test_files_ruled_out_are_not_opened(spark, tmp_path):
    root = str(tmp_path / "lake")
    write_lake(spark.createDataFrame(topic_rows(400, 5), SCHEMA), root)
    add_bounds(spark, root)
    query = topic_rows(DAYS, 11)[4][9]
    wanted = sets(search_stored(lake_scan(spark, root), query, domain=None))
    files = files_to_read(spark, root, query, domain=None, seeds=1).collect()
    left = [row["file"] for row in files if not row["read"]]
    assert len(left) > DAYS / 2
    for file in left:
        with open(os.path.join(root, file), "wb") as out:
            out.write(b"not parquet")
        crc = os.path.join(root, os.path.dirname(file), f".{os.path.basename(file)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert sets(search_bounded(spark, root, query, domain=None, seeds=1)) == wanted
    with pytest.raises((PySparkException, Py4JError)):
        search_stored(lake_scan(spark, root), query, domain=None).collect()


def test_later_files_are_read_until_they_are_measured(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    query = topic_rows(DAYS, 11)[4][9]
    assert search_bounded(spark, root, query).collect() == []
    add_bounds(spark, root)  # nothing to measure
    write_lake(spark.createDataFrame(topic_rows(200, 5), SCHEMA), root)
    add_bounds(spark, root)
    before = lake_bounds(spark, root).count()
    add_bounds(spark, root)
    assert lake_bounds(spark, root).count() == before
    write_lake(spark.createDataFrame(topic_rows(60, 6, "later"), SCHEMA), root)
    stored = lake_scan(spark, root)
    unknown = bounded_files(spark, root, query).where(F.col("bound") == math.inf).count()
    assert 0 < unknown < lake_files(spark, root).count()
    for named in (bounds.NAMED, 1):  # names in a filter, or joined
        monkeypatch.setattr(bounds, "NAMED", named)
        assert sets(search_bounded(spark, root, query, k=20)) == sets(search_stored(stored, query, k=20))
    add_bounds(spark, root)
    assert bounded_files(spark, root, query).where(F.col("bound") == math.inf).count() == 0
    assert sets(search_bounded(spark, root, query, k=20)) == sets(search_stored(stored, query, k=20))


def test_odd_vectors_stay_without_a_bound(spark, tmp_path):
    schema = "file string, embedding array<float>"
    rows = [("a", [1.0, 0.0]), ("a", [-1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("c", [1.0, 2.0]), ("d", None), ("e", [float("nan"), 1.0]),
            ("f", [1.0, None]), ("g", [3.0, 4.0]), ("h", [])]
    found = {r["file"]: r for r in measured(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
    assert set(found) == set("abcefgh")
    assert math.isclose(found["a"]["reach"], math.pi) and found["a"]["n"] == 2
    assert all(found[f]["reach"] is None for f in "bcefh") and found["g"]["reach"] < 1e-6
    assert found["c"]["dim"] is None and found["b"]["dim"] == 2
    root = str(tmp_path / "lake")
    odd = [(*row[:9], vector, "{}") for row, vector in zip(topic_rows(6, 5), ([1.0, 0.0], [0.0, 0.0], [1.0, 1.0], [0.0, 1.0], [-1.0, 0.0], [2.0, 0.0, 0.0]))]
    write_lake(spark.createDataFrame(odd, SCHEMA), root)
    add_bounds(spark, root)
    stored = lake_scan(spark, root)
    options = {"domain": None, "lenient": True, "similarity_threshold": -1.0}
    for k in (1, 2, 9):
        assert sets(search_bounded(spark, root, [1.0, 0.1], k=k, seeds=1, **options)) == sets(search_stored(stored, [1.0, 0.1], k=k, **options))
    with pytest.raises((PySparkException, Py4JError)):
        search_bounded(spark, root, [1.0, 0.1], domain=None).collect()


def test_prompt_and_example_read_by_place(spark, root):
    stored = lake_scan(spark, root)
    query = topic_rows(DAYS, 11)[6][9]
    found = prompt_search_bounded(spark, root, query, 8)
    assert sets(found) == sets(prompt_search(stored, query, 8).select(*found.columns))
    found = search_by_example_bounded(spark, root, ["Text 17", "text 1999"], 8)
    plain = search_by_example(stored, ["Text 17", "text 1999"], 8).withColumn("cosine_similarity", F.round("cosine_similarity", 4))
    assert sets(found) == sets(plain.select(*found.columns))
    assert search_by_example_bounded(spark, root, ["nowhere"]).collect() == []
