"""Folders of very many small files: how they are written and how many tasks scan them."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.sources import queue as listings
from quire.sources.documents import raw_scan
from quire.sources.scratch import numbered_files, paths_exist, put_files
from quire.streaming.intake import Intake, intake_session
from quire.streaming.stability import IntakeGate


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_become_one_file_each(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("ü\n",)], "text string").repartition(3)
    assert put_files(rows.select(*numbered_files(F.col("text"))), str(tmp_path / "out")) == 4
    found = sorted((tmp_path / "out" / name).read_text() for name in os.listdir(tmp_path / "out"))
    assert found == ["\n", "a\n", "a\n", "ü\n\n"]


def test_no_rows_leave_an_empty_folder(spark, tmp_path):
    rows = spark.createDataFrame([], "text string")
    assert put_files(rows.select(*numbered_files(F.col("text"))), str(tmp_path / "out")) == 0
    assert raw_scan(spark, str(tmp_path / "out")).collect() == []


def test_scan_of_small_files_takes_few_tasks(spark, tmp_path, small_splits):
    for n in range(120):
        (tmp_path / f"{n}.txt").write_text(f"text {n}")
    docs = raw_scan(spark, str(tmp_path))
    assert docs.count() == 120
    assert docs.rdd.getNumPartitions() <= 24


def test_queue_listing_takes_few_tasks(spark, tmp_path, small_splits):
    for n in range(120):
        (tmp_path / f"{n}.htm").write_text("x")
    files = listings.queue_files(spark, str(tmp_path), "/none/a", "/none/b")
    assert files.count() == 120
    assert files.rdd.getNumPartitions() <= 24


def test_an_offered_batch_is_read_in_few_tasks(spark, tmp_path, small_splits):
    for n in range(120):
        (tmp_path / f"{n}.txt").write_text(f"text {n}")
    session = intake_session(spark)
    session.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    paths = [(f"file:{tmp_path}/{n}.txt", len(f"text {n}"), 1) for n in range(120)] + [(f"file:{tmp_path}/gone.txt", 1, 1)]
    offered = session.createDataFrame(paths, "path string, size bigint, attempt int")
    spark.sparkContext.setJobGroup("offered", "")
    try:
        assert Intake(str(tmp_path / "lake"), str(tmp_path / "records"))._read(offered).count() == 120
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("offered") for s in tracker.getJobInfo(j).stageIds]
    assert max(i.numTasks for i in map(tracker.getStageInfo, stages) if i) <= 24


def test_files_that_are_there_are_not_asked_for_one_by_one(spark, tmp_path, monkeypatch):
    from quire.streaming import intake

    asked = []
    monkeypatch.setattr(intake, "paths_exist", lambda s, paths: asked.append(len(paths)) or paths_exist(s, paths))
    (tmp_path / "odd [1]{x}.txt").write_text("text")
    told = [(f"file:{tmp_path}/{name}.txt", 4, 1) for name in ("odd [1]{x}", "gone [1]", "gone")]
    read = lambda n: Intake("/none", "/none")._read(spark.createDataFrame(n, "path string, size bigint, attempt int"))
    assert read(told[:1]).count() == 1 and asked == []
    assert read(told).count() == 1 and asked == [3]
    assert read(told[:2]).count() == 1 and read(told[1:]) is None and read(told[:0]) is None


def test_paths_exist_in_order(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("x")
    paths = [f"{tmp_path}/none", f"{tmp_path}/a b.txt", f"file:{tmp_path}/a b.txt", f"file://{tmp_path}/none"]
    assert paths_exist(spark, paths) == [False, True, True, False]


def test_the_gate_takes_rows_and_two_messages_a_path():
    """The state of a path is fetched once and kept once, and what a sweep saw comes as rows, not as a frame a path."""
    held, messages = {}, []

    class Value:
        def get(self):
            messages.append("get")
            return held.get(path)

        def update(self, value):
            messages.append("update")
            held[path] = value

    class Handle:
        def getValueState(self, *args, **options):
            return Value()

    gate, offered = IntakeGate(1.0, 2, 60.0), []
    gate.init(Handle())
    seen = [(5, 1, 0, False), (5, 1, 1, False), (5, 1, 2, False), (5, 1, 3, False), (1, None, 4, True), (5, 1, 5, False), (5, 1, 7, False), (5, 1, 6, False)]
    for sweep in (seen[:1], seen[1:2], seen[2:4], seen[4:]):
        for path in ("a", "b"):
            rows = (Row(path=path, size=s, modified=m, at=at * 1_000_000, again=again) for s, m, at, again in sweep)
            offered += [(r.path, r.at // 1_000_000, r.attempt) for r in gate.handleInputRows((path,), rows, None)]
    assert sorted(offered) == [(p, at, n) for p in "ab" for at, n in ((2, 1), (7, 2))]
    assert len(messages) == 16


def test_the_gate_takes_observations_without_times():
    """One without a time comes last, one without a time of change is a change; neither ends the stream."""
    held = {}

    class Value:
        def get(self):
            return held.get("state")

        def update(self, value):
            held["state"] = value

    class Handle:
        def getValueState(self, *args, **options):
            return Value()

    def offers(*sweeps):
        held.clear()
        gate = IntakeGate(1e-6, 2, 60.0)
        gate.init(Handle())
        rows = ([Row(path="a", size=5, modified=m, at=at, again=False) for m, at in sweep] for sweep in sweeps)
        return [(r.modified, r.at) for sweep in rows for r in gate.handleInputRows(("a",), iter(sweep), None)]

    assert offers([(1, None), (1, 9), (1, 0), (1, 5)]) == [(1, 9)]
    assert offers([(1, None), (1, 3), (1, None), (1, 9)], [(1, 12)]) == [(1, None)]
    assert offers([(None, at) for at in (0, 5, 10)], [(None, 15)]) == []
    assert offers([(1, None)], [(1, 5)], [(1, None), (1, 9)]) == [(1, 9)]
