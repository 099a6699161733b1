import json
import os
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.display import format_bytes, format_item_size, format_volume
from quire.operators import filings, queue, telemetry
from quire.plans import ingest
from quire.operators.retrieval import search
from quire.sources import filings as indexes
from quire.sources import lake, records
from quire.sources import queue as listings
from quire.sources.documents import intake_filter, raw_scan, sidecar_files
from quire.sources.lake import lake_scan, write_lake
from quire.streaming.intake import Intake, ask_again, settle_offered, stream_ingest, sweep_ingest, watch
from quire.streaming.stability import ROCKSDB, Seen, advance, stream_write_complete, summarise, through, write_complete
from tests.test_retrieval import ROWS, SCHEMA

DAY = date(2025, 3, 1)


def test_write_lake_layout_and_read_back(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = [*ROWS[:3], ("c9", "d9", " General ", "z.txt", "MISC", None, "General", False, "t", [1.0], "{}")]
    lake.write_lake(spark.createDataFrame(rows, SCHEMA), root, DAY)
    folders = sorted({os.path.relpath(d, root) for d, _, files in os.walk(root) if any(f.endswith(".parquet") for f in files)})
    assert folders == [
        "domain=finance/year=2024/month=02/day=21", "domain=finance/year=2024/month=05/day=15", "domain=general/year=2025/month=03/day=01",
    ]
    stored = lake.lake_scan(spark, root)
    assert stored.count() == 4 and lake.lake_scan(spark, root, "FINANCE").count() == 3
    late = stored.where("chunk_id = 'c9'").first()
    assert late["filing_date"] is None and (late["domain"], late["year"], late["month"], late["day"]) == ("general", 2025, 3, 1)
    assert lake.lake_scan(spark, root + "-none").collect() == []
    assert lake.lake_scan(spark, root, "law").collect() == []
    files = lake.lake_files(spark, root)
    assert {(r["domain"], r["year"], r["month"], r["day"]) for r in files.collect()} >= {("finance", "2024", "02", "21")}
    stats = telemetry.lake_stats(files).first()
    assert (stats["total_parquet_files"], stats["domains"], stats["partitions"]) == (3, ["finance", "general"], folders)
    kpis = telemetry.lake_kpis(files).first()
    assert (kpis["total_files"], kpis["domains"], kpis["partitions"]) == (3, 2, 3)
    assert kpis["total_bytes"] == stats["total_size_bytes"] > 0


def test_missing_embeddings_refuse_the_batch(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn(
        "embedding", F.when(F.col("chunk_id").isin("c2", "c4"), F.array().cast("array<float>")).otherwise(F.col("embedding"))
    )
    with pytest.raises(lake.MissingEmbeddings, match=r"2 chunks .*c2.*c4"):
        lake.write_lake(rows, root)
    assert lake.lake_scan(spark, root).count() == 0 if os.path.exists(root + "/_SUCCESS") else True
    with pytest.raises(ValueError):
        lake.embedding_check(rows)
    lake.embedding_check(spark.createDataFrame(ROWS, SCHEMA))


def test_a_busy_day_is_split_over_tasks(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = spark.createDataFrame(ROWS[:1], SCHEMA).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20000)))).repartition(8)
    rows = rows.withColumn("text", F.sha2(F.col("n").cast("string"), 512)).withColumn("chunk_id", F.col("n").cast("string")).drop("n")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        lake.write_lake(rows, root)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert lake.lake_files(spark, root).count() > 1 and lake.lake_scan(spark, root).count() == 20000


HTML = (
    "<html><h1>Item 1A. Risk Factors</h1><p>Supply may be constrained.</p><h1>Item 8. Financial Statements</h1>"
    "<table><tr><td>Revenue</td><td>60,922</td></tr></table></html>"
)


def test_documents_to_lake_to_search(spark, tmp_path):
    drop, root = tmp_path / "in", str(tmp_path / "lake")
    drop.mkdir()
    (drop / "NVDA_10-K.htm").write_text(HTML)
    (drop / "NVDA_10-K.htm.meta.json").write_text(
        json.dumps({"doc_id": "acc", "source_filename": "f", "domain": "finance", "form_type": "10-K", "filing_date": "2024-02-21"})
    )
    ingest.ingest(raw_scan(spark, str(drop)), root, sidecar_files(spark, str(drop)))
    stored = lake.lake_scan(spark, root)
    assert [(r["section"], r["is_table"]) for r in stored.orderBy("is_table", "section", "text").collect()][-1] == ("Item 8 - Financial Statements", True)
    probe = stored.where("text LIKE 'Supply%'").first()
    hit = search(stored, probe["embedding"], k=1).first()
    assert hit["chunk_id"] == probe["chunk_id"] and round(hit["similarity_score"], 6) == 1.0 and hit["section"] == "Item 1A - Risk Factors"
    assert lake.lake_files(spark, root).select("year", "month", "day").distinct().collect() == [("2024", "02", "21")]


def test_stream_ingest_settles_once(spark, tmp_path):
    drop, root, notes, mark = tmp_path / "in", str(tmp_path / "lake"), str(tmp_path / "records"), str(tmp_path / "mark")
    drop.mkdir()
    (drop / "a.htm").write_text(HTML)
    (drop / "a.meta.json").write_text(json.dumps({"doc_id": "acc", "source_filename": "a.htm", "form_type": "10-Q"}))
    (drop / "b.json").write_text("{")
    (drop / "c.txt.tmp").write_text("x")
    intake = Intake(root, notes, lambda s: sidecar_files(s, str(drop)), ingest_date=DAY)
    stream_ingest(watch(spark, str(drop)), intake, mark).awaitTermination()
    got = {os.path.basename(r["file_path"]): (r["status"], r["chunk_count"], len(r["parquet_paths"])) for r in intake.summaries(spark).collect()}
    assert got == {"a.htm": ("completed", 4, 1), "b.json": ("failed", 0, 0)}
    assert {r["form_type"] for r in lake.lake_scan(spark, root).collect()} == {"10-Q"}
    (drop / "d.txt").write_text("new\n\nfile")
    stream_ingest(watch(spark, str(drop)), intake, mark).awaitTermination()
    assert lake.lake_scan(spark, root).count() == 6 and intake.summaries(spark).count() == 3
    letters = spark.read.json(f"{notes}/dead_letters").collect()
    assert [(r["source_filename"], r["error_type"], r["file_size_bytes"]) for r in letters] == [("b.json", "DocumentParsingError", 1)]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    drop, root, notes = tmp_path / "in", str(tmp_path / "lake"), str(tmp_path / "records")
    drop.mkdir()
    (drop / "a.htm").write_text(HTML)
    files = spark.read.format("binaryFile").load(str(drop))
    intake = Intake(root, notes)
    intake.settle(files, 7)
    before = {r["chunk_id"] for r in lake.lake_scan(spark, root).collect()}
    intake.settle(files, 7)
    # A try that died before its summary: half of the rows are in the lake already.
    os.rename(f"{notes}/summaries/batch=7", f"{notes}/lost")
    intake.settle(files, 7)
    after = [r["chunk_id"] for r in lake.lake_scan(spark, root).collect()]
    assert len(after) == 4 and set(after) == before
    assert intake.summaries(spark).first()["chunk_count"] == 4


def fold(rows, interval, checks):
    """Write-completeness by the rules, one observation at a time."""
    state, done = {}, []
    for path, at, size in sorted(rows):
        if size == 0:
            continue
        seen = state.get(path)
        if seen is None:
            state[path] = [size, at, 0]
        elif at - seen[1] >= interval:
            if size == seen[0]:
                seen[1], seen[2] = at, seen[2] + 1
                if seen[2] >= checks:
                    done.append((path, at))
                    del state[path]
            else:
                state[path] = [size, at, 0]
    return sorted(done)


def observation_rows():
    import random

    rng = random.Random(5)
    rows = set()
    for path, n in (("hot", 3000), ("a", 40), ("b", 7), ("still", 200)):
        at, size = 0.0, rng.choice([0, 3])
        for _ in range(n):
            at += rng.choice([0.25, 0.5, 1.0, 1.5, 4.0])
            if path != "still" and rng.random() < 0.3:
                size += 1
            rows.add((path, at, size))
    return sorted(rows)


@pytest.mark.parametrize("block", [5, 60, 10**6])
def test_batch_write_completeness_is_exact_for_any_gaps(spark, block):
    rows = observation_rows()
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(p, start + timedelta(seconds=t), s) for p, t, s in rows], "path string, observed_at timestamp, size bigint")
    for many in (5, 10**9):
        got = write_complete(df.repartition(4), 1.0, 2, block_seconds=block, many=many).collect()
        assert sorted((r["path"], (r["observed_at"] - start).total_seconds()) for r in got) == fold(rows, 1.0, 2)


@pytest.mark.parametrize("checks", [1, 2, 4])
def test_blocks_do_to_any_state_what_their_observations_do(checks):
    rng = np.random.default_rng(checks)
    for trial in range(300):
        n, step = int(rng.integers(1, 40)), int(rng.integers(1, 12))
        at = np.cumsum(rng.integers(0, step, n)).astype(np.int64)
        size = np.repeat(rng.integers(1, 3, n), rng.integers(1, 9, n))[:n].astype(np.int64)
        modified = (rng.random(n) < 0.05).astype(np.int64)
        interval = int(rng.integers(0, 15))
        block = summarise(size, modified, at, interval, checks)
        for seen in [None] + [Seen(int(size[0]), 0, int(at[0]) - g, c) for g in range(17) for c in range(checks)]:
            state = seen
            for values in zip(size.tolist(), modified.tolist(), at.tolist()):
                state, _ = advance(state, *values, interval, checks)
            assert through(block, seen, interval) == state, (trial, seen)


@pytest.mark.parametrize("many", [0, 50, 10**9])
def test_one_path_that_never_changes_spreads_over_tasks(spark, many):
    """9,000 of 10,000 observations are of one file of one size; its blocks are groups of their own."""
    start = datetime(2024, 1, 1)
    rows = [("hot", 0.25 * i, 7) for i in range(9000)] + [(f"p{i % 90}", 0.75 * (i // 90), 1 + i // 500) for i in range(1000)]
    df = spark.createDataFrame([(p, start + timedelta(seconds=t), s) for p, t, s in rows], "path string, observed_at timestamp, size bigint")
    done = write_complete(df, 1.0, 2, block_seconds=60, many=many)
    got = sorted((r["path"], round((r["observed_at"] - start).total_seconds(), 1)) for r in done.collect())
    assert got == sorted((p, round(t, 1)) for p, t in fold(rows, 1.0, 2)) and len(got) > 1000
    if many == 50:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tasks are merged otherwise
        try:
            parts = done.select(F.spark_partition_id().alias("task"), "path").where("path = 'hot'").distinct()
            assert parts.count() > 4
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_streaming_write_completeness(spark, tmp_path):
    rows = [r for r in observation_rows() if r[0] != "hot"]
    start = datetime(2024, 1, 1)
    cut = len(rows) // 2
    source = tmp_path / "obs"
    schema = "path string, observed_at timestamp, size bigint"
    rows.sort(key=lambda r: r[1])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        done = []
        for part in (rows[:cut], rows[cut:]):
            data = [(p, start + timedelta(seconds=t), s) for p, t, s in part]
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(source))
            stream = stream_write_complete(spark.readStream.schema(schema).parquet(str(source)), 1.0, 2)
            query = (
                stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
                .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
            )
            query.awaitTermination()
        done = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r["path"], (r["observed_at"] - start).total_seconds()) for r in done) == fold(rows, 1.0, 2)


def test_gated_intake(spark, tmp_path):
    """A growing file enters once and whole, equal names are two files, a failed one is tried again as the next attempt."""
    drop, work = tmp_path / "drop", str(tmp_path / "work")
    for folder in ("a", "b"):
        (drop / folder).mkdir(parents=True)
    start = datetime(2025, 3, 1, tzinfo=timezone.utc)
    clock = iter(start + timedelta(seconds=n) for n in range(100))

    def sweep(n):
        sweep_ingest(spark, f"{drop}/*", intake, work, [next(clock) for _ in range(n)])
        return {(r["file_path"].split("drop/")[1], r["attempt"], r["status"], r["chunk_count"]) for r in intake.summaries(spark).collect()}

    intake = Intake(f"{work}/lake", f"{work}/records", ingest_date=date(2025, 3, 1))
    (drop / "a" / "same.txt").write_text("First of the name.")
    (drop / "b" / "same.txt").write_text("Second of the name.\n\nWith two chunks in it.")
    (drop / "a" / "odd [1]{x}.txt").write_text("Names with signs of a pattern.")
    (drop / "a" / "bad.json").write_text('{"title": ')
    (drop / "a" / "grown.txt").write_text("Half")
    assert sweep(2) == set()
    (drop / "a" / "grown.txt").write_text("Half and then the whole of it.")
    done = {("a/same.txt", 1, "completed", 1), ("b/same.txt", 1, "completed", 2), ("a/odd [1]{x}.txt", 1, "completed", 1), ("a/bad.json", 1, "failed", 0)}
    assert sweep(2) == done
    done |= {("a/grown.txt", 1, "completed", 1)}
    assert sweep(1) == done
    texts = [r["text"] for r in lake_scan(spark, intake.root).where("source_filename = 'grown.txt'").collect()]
    assert texts == ["Half and then the whole of it."]
    states = {r["file_path"].rsplit("/", 1)[1]: r for r in intake.states(spark).collect()}
    assert states["bad.json"]["error_file"].endswith("/a/bad.json.error.json") and states["grown.txt"]["error_file"] is None
    # Asked for again it fails again; mended it is the third attempt and done. A restart offers nothing.
    ask_again(intake.states(spark).where("status = 'failed'").selectExpr("file_path AS path"), f"{work}/observations", next(clock))
    done |= {("a/bad.json", 2, "failed", 0)}
    assert sweep(3) == done
    (drop / "a" / "bad.json").write_text('{"title": "t", "content": "Mended."}')
    done |= {("a/bad.json", 3, "completed", 2)}
    assert sweep(3) == done
    settle_offered(spark, intake, work)
    assert sweep(1) == done
    state = [r for r in intake.states(spark).collect() if r["file_path"].endswith("bad.json")][0]
    assert (state["attempt"], state["status"], state["error_file"]) == (3, "completed", None)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB


def test_scan_of_a_domain_lists_its_folder_only(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = [(f"c{i}", "d", d, "f", "MISC", date(2024, 1, 1), "General", False, "t", [1.0], "{}") for i, d in enumerate(["a b", "finance"])]
    names = "chunk_id string, doc_id string, domain string, source_filename string, form_type string, filing_date date, section string, is_table boolean, text string, embedding array<float>, metadata_json string"
    write_lake(spark.createDataFrame(rows, names), root)
    (tmp_path / "lake" / "domain=finance" / "year=2024" / "month=01" / "day=01" / "broken.parquet").write_bytes(b"no parquet")
    found = lake_scan(spark, root, " A B ")
    assert [(r["chunk_id"], r["domain"], r["month"]) for r in found.collect()] == [("c0", "a b", 1)]
    assert all("domain=a" in f for f in found.inputFiles())
    assert lake_scan(spark, root, "none").count() == 0


def test_one_observation_at_a_time():
    second = 1_000_000
    state, done = advance(None, 5, 0, 0, second, 2)
    state, done = advance(state, 5, 0, second // 2, second, 2)
    assert state.unchanged == 0 and not done
    state, done = advance(state, 5, 0, second, second, 2)
    state, done = advance(state, 5, 0, 2 * second, second, 2)
    assert done and state is None


def test_intake_names(spark):
    names = ["a.HTM", "a.pdf", "b.htm.meta.json", ".c.txt", "d.txt.tmp", "e.docx", "f.json", "g.txt"]
    df = spark.createDataFrame([(f"file:/in/{n}", 0 if n == "g.txt" else 3) for n in names], "path string, length bigint")
    assert [r["path"].split("/")[-1] for r in intake_filter(df).collect()] == ["a.HTM", "a.pdf", "f.json"]


@pytest.fixture
def folders(tmp_path):
    made = [tmp_path / n for n in ("incoming", "processed", "failed")]
    for d in made:
        d.mkdir()
    (made[0] / "new.pdf").write_bytes(b"1" * 100)
    (made[0] / "part.htm.crdownload").write_bytes(b"1")
    (made[1] / "AAPL.htm").write_bytes(b"1" * 200)
    (made[1] / "AAPL.htm.meta.json").write_text(json.dumps({"ticker": "AAPL", "form_type": "10-K", "company_name": "Apple Inc.", "domain": "finance"}))
    (made[2] / "bad.json").write_bytes(b"{")
    (made[2] / "bad.json.error.json").write_text(json.dumps({"error_type": "JSONDecodeError", "error_message": "no"}))
    return [str(d) for d in made]


def test_queue_over_folders(spark, folders):
    items = queue.queue_items(
        listings.queue_files(spark, *folders), listings.queue_sidecars(spark, *folders), listings.error_records(spark, folders[2])
    )
    rows = {r["filename"]: r for r in items.collect()}
    assert {n: r["status"] for n, r in rows.items()} == {"new.pdf": "PENDING", "AAPL.htm": "PROCESSED", "bad.json": "FAILED"}
    assert (rows["AAPL.htm"]["ticker"], rows["AAPL.htm"]["has_metadata"], rows["new.pdf"]["domain"]) == ("AAPL", True, "finance")
    assert (rows["bad.json"]["error_type"], rows["bad.json"]["error_message"]) == ("JSONDecodeError", "no")
    assert [r["filename"] for r in queue.queue_filter(items, "all", "apple").collect()] == ["AAPL.htm"]
    assert [r["filename"] for r in queue.queue_filter(items, "failed").collect()] == ["bad.json"]
    retried = queue.requeue(items, spark.createDataFrame([("bad.json",), ("AAPL.htm",)], "filename string"))
    state = {r["filename"]: (r["status"], r["attempt"], r["error_type"]) for r in retried.collect()}
    assert state["bad.json"] == ("PENDING", 2, None) and state["AAPL.htm"] == ("PROCESSED", 1, None)
    assert listings.queue_files(spark, "/none/a", "/none/b", "/none/c").collect() == []


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_queue_metrics(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        check_queue_metrics(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def check_queue_metrics(spark):
    rows = [("a", "PENDING", 100, 1.0), ("b", "PROCESSED", 200, 2.0), ("c", "PROCESSED", 300, 1704067200.0), ("d", "PROCESSED", 500, 3.0), ("e", "FAILED", 50, 9e9)]
    schema = "filename string, status string, file_size_bytes bigint, mtime double"
    m = queue.queue_metrics(spark.createDataFrame(rows, schema)).first()
    assert (m["incoming_count"], m["processed_count"], m["failed_count"], m["total_processed_bytes"]) == (1, 3, 1, 1000)
    assert m["failure_rate_pct"] == 25.0 and m["latest_ingest_time"] == "2024-01-01 00:00:00 UTC"
    empty = queue.queue_metrics(spark.createDataFrame([], schema)).first()
    assert empty["failure_rate_pct"] == 0.0 and empty["latest_ingest_time"] is None


def test_metadata_lookup_prefers_the_hinted_folder(spark):
    sidecars = spark.createDataFrame(
        [("PROCESSED", "a.htm.meta.json", '{"k":"p"}'), ("FAILED", "a.meta.json", '{"k":"f"}'), ("PENDING", "b.meta.json", "{}"), ("FAILED", "b.meta.json", '{"k":"b"}')],
        "status string, sidecar_name string, body string",
    )
    asked = spark.createDataFrame([("a.htm", None), ("a.htm", "failed"), ("b.txt", "pending"), ("c.txt", None)], "filename string, status string")
    got = {(r["filename"], r["hint"]): r["body"] for r in queue.metadata_lookup(asked, sidecars).collect()}
    assert got == {("a.htm", None): '{"k":"p"}', ("a.htm", "FAILED"): '{"k":"f"}', ("b.txt", "PENDING"): '{"k":"b"}', ("c.txt", None): None}


def test_unique_destinations(spark):
    moves = spark.createDataFrame([("/a/x.htm", "x.htm"), ("/b/x.htm", "x.htm"), ("/c/y.htm", "y.htm")], "path string, filename string")
    taken = spark.createDataFrame([("y.htm",)], "filename string")
    dest = {r["path"]: r["dest"] for r in queue.unique_dest(moves, taken).collect()}
    assert dest["/a/x.htm"] == "x.htm" and len(set(dest.values())) == 3 and dest["/c/y.htm"].startswith("y_") and dest["/c/y.htm"].endswith(".htm")


def test_byte_texts(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536 * 1024,), (3 * 1024**3,)], "n bigint")
    rows = df.select(format_bytes(F.col("n")), format_item_size(F.col("n")), format_volume(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["0 B", "1023 B", "1.0 KB", "1.50 MB", "3.00 GB"]
    assert [r[1] for r in rows][-1] == "3072.00 MB" and [r[2] for r in rows] == ["0.0 MB", "0.0 MB", "0.0 MB", "1.5 MB", "3.00 GB"]


def test_filings(spark):
    index = indexes.ticker_index(
        spark.createDataFrame([('{"0": {"cik_str": 1045810, "ticker": "nvda", "title": "NVIDIA CORP"}, "1": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple Inc."}}',)], "body string")
    )
    assert indexes.require_ticker(" nvda ", index) == "0001045810"
    with pytest.raises(indexes.UnknownTicker):
        indexes.require_ticker("ZZZ", index)
    body = json.dumps({"cik": "1045810", "name": "N", "filings": {"recent": {
        "accessionNumber": ["0001-24-1", "0001-24-2", "0001-23-3"], "filingDate": ["2024-02-21", "2024-05-29", "2023-02-24"],
        "reportDate": ["2024-01-28", "2024-04-28"], "form": ["10-K", "10-Q", "10-K"], "primaryDocument": ["a.htm", "b", "c.htm"]}}})
    rows = indexes.filing_index(spark.createDataFrame([("NVDA", body), ("NONE", "{}")], "ticker string, body string"))
    assert [r["report_date"] for r in rows.orderBy("position").collect()] == ["2024-01-28", "2024-04-28", ""]
    pick = lambda **o: [r["accession"] for r in filings.select_filings(rows, **o).orderBy("position").collect()]
    assert pick() == ["0001-24-1"] and pick(limit=5) == ["0001-24-1", "0001-23-3"]
    assert pick(form_type="10-q") == ["0001-24-2"] and pick(year=2023) == ["0001-23-3"]
    assert pick(start_date=date(2024, 2, 22)) == [] and pick(end_date="2023-12-31") == ["0001-23-3"]
    targets = filings.filing_targets(rows).orderBy("position").collect()
    assert targets[0]["document_url"] == "https://www.sec.gov/Archives/edgar/data/1045810/0001241/a.htm"
    assert [t["target_filename"] for t in targets] == ["NVDA_10-K_20240221.htm", "NVDA_10-Q_20240529.htm", "NVDA_10-K_20230224.htm"]
    side = json.loads(records.filing_sidecars(filings.filing_targets(rows.where("position = 0")).withColumn("company_name", F.lit("N"))).first()["body"])
    assert side["doc_id"] == "0001-24-1" and side["extra"]["report_date"] == "2024-01-28"
    assert filings.date_presets(date(2026, 3, 1))["Year to Date (YTD)"] == (date(2026, 1, 1), date(2026, 3, 1))
