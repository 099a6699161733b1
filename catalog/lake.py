"""Lake storage, inventory and streaming queries."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from catalog.documents import CHUNKS, SLICED, all_docs, html_docs, tokens_sql
from catalog.retrieval import EXAMPLE, PROMPT_VECTOR, SCORED, lake, query_vector, rounded
from catalog.retrieval import ORACLES as RANKED
from catalog.views import table, view, with_views
from quire.functions.display import format_bytes, format_item_size, format_volume
from quire.functions.text import base_name
from quire.operators import bounded, retrieval, telemetry
from quire.operators.queue import dispatch_once
from quire.plans import ingest
from quire.sources.bounds import add_bounds
from quire.sources.lake import lake_files, lake_scan, missing_embeddings, write_lake
from quire.sources.scratch import put_files, scratch_dir
from quire.streaming.intake import Intake, sweep_ingest
from quire.streaming.stability import write_complete

TODAY = date(2025, 3, 1)


def written(spark, sf):
    root = scratch_dir(spark, "lake")
    write_lake(lake(spark, sf), root, TODAY)
    return root


def lake_write(spark, sf):
    """Every chunk written to the lake and read back with its path columns."""
    rows = lake_scan(spark, written(spark, sf))
    values = F.array_join(F.transform("embedding", lambda v: F.round(v.cast("double") * 1e4).cast("bigint").cast("string")), ",")
    return rows.withColumn("embedding", values)


def scan(spark, sf):
    rows = lake_scan(spark, written(spark, sf), "Finance ")
    return rows.select("chunk_id", "domain", "year", "month", "day", "filing_date")


def lake_search(spark, sf):
    """Search over the stored lake: the date range skips folders, and text is read for the winners only."""
    stored = lake_scan(spark, written(spark, sf))
    options = {"start_date": date(2024, 3, 1), "end_date": date(2024, 9, 30), "k": 15}
    hits = retrieval.search_stored(stored, query_vector(spark, sf), **options)
    return rounded(hits).select("chunk_id", "filing_date", "text", "similarity_score")


def measured(spark, sf):
    root = written(spark, sf)
    add_bounds(spark, root)
    return root


def bounded_search(spark, sf):
    """The same search; files whose bounds rule them out are not opened."""
    options = {"start_date": date(2024, 3, 1), "end_date": date(2024, 9, 30), "k": 15}
    hits = bounded.search_bounded(spark, measured(spark, sf), query_vector(spark, sf), **options)
    return rounded(hits).select("chunk_id", "filing_date", "text", "similarity_score")


def file_bounds(spark, sf):
    """Every folder's best score for a query, and whether it stays below the bounds of the folder's files; those that
    cannot hold one of the 15 best hits are marked as left unread."""
    root, vector = measured(spark, sf), query_vector(spark, sf)
    path = [F.col(c).cast("int").alias(c) for c in ("year", "month", "day")]
    files = bounded.files_to_read(spark, root, vector, domain=None, k=15)
    bounds = files.groupBy("domain", *path).agg(F.max("bound").alias("bound"), F.bool_or("read").alias("read"))
    scores = retrieval.with_cosine(lake_scan(spark, root), vector).groupBy("domain", "year", "month", "day")
    best = scores.agg(F.max("similarity_score").alias("best"), F.count("*").alias("rows"))
    told = bounds.join(best, ["domain", "year", "month", "day"])
    least = retrieval.top_k(retrieval.with_cosine(lake_scan(spark, root), vector).select("chunk_id", "similarity_score"), 15)
    needed = told["best"] >= least.agg(F.min("similarity_score")).scalar()
    holds = (F.col("best") <= F.col("bound")) & (F.col("read") | ~needed)
    return told.select("domain", "year", "month", "day", "rows", F.round("best", 6).alias("best"), holds.alias("holds"))


def prompt_stored(spark, sf):
    return bounded.prompt_search_bounded(spark, measured(spark, sf), PROMPT_VECTOR)


def example_stored(spark, sf):
    hits = bounded.search_by_example_bounded(spark, measured(spark, sf), EXAMPLE)
    return hits.withColumn("cosine_similarity", F.round("cosine_similarity", 4))


def embedding_check(spark, sf):
    """Vectors of one label removed, of another emptied: the count and three identifiers a write would report."""
    label = F.substring("chunk_id", 2, 9).cast("int") % 10
    vector = F.when(label == 3, F.lit(None)).when(label == 4, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    found = missing_embeddings(lake(spark, sf).withColumn("embedding", vector))
    return found.select("missing", F.array_join("examples", ",").alias("examples"))


def files(spark, sf):
    """Folders of the listing; file names and sizes depend on the writer, so only their form is compared."""
    listing = lake_files(spark, written(spark, sf))
    sized = (F.col("size_bytes") > 0) & F.col("size_formatted").rlike(r"^[0-9.]+ (B|KB|MB|GB)$")
    named = F.col("filename").endswith(".parquet") & F.col("relative_path").startswith("domain=")
    return listing.groupBy("domain", "year", "month", "day").agg(F.bool_and(sized & named).alias("well_formed"))


def lake_stats(spark, sf):
    stats = telemetry.lake_stats(lake_files(spark, written(spark, sf)))
    return stats.select(
        "total_parquet_files",
        (F.col("total_size_bytes") > 0).alias("has_bytes"),
        F.array_join("domains", ",").alias("domains"),
        F.array_join("partitions", ",").alias("partitions"),
    )


def lake_kpis(spark, sf):
    kpis = telemetry.lake_kpis(lake_files(spark, written(spark, sf)))
    return kpis.withColumn("total_bytes", F.col("total_bytes") > 0)


def sizes(spark, sf):
    """Order values stretched over all units."""
    size = (F.col("o_totalprice") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 6).cast("double"))).cast("bigint")
    rows = table(spark, sf, "orders").select("o_orderkey", size.alias("size"))
    return rows.select(
        "o_orderkey",
        format_bytes(F.col("size")).alias("size_text"),
        format_item_size(F.col("size")).alias("item_text"),
        format_volume(F.col("size")).alias("volume_text"),
    )


def complete_writes(spark, sf):
    done = write_complete(view(spark, sf, "file_observations"), 3600, 2, ("event_id",), block_seconds=7 * 86400)
    return done.select("path", "event_id", "size")


def dispatch(spark, sf):
    """Observed files that are not in flight: those whose last observation is not a refund."""
    observed = view(spark, sf, "file_observations").select("path")
    latest = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    in_flight = latest.where("kind = 'click'").select(F.concat(F.lit("f"), "user_id", F.lit(".htm")).alias("path"))
    return dispatch_once(observed, in_flight)


def streamed_intake(spark, sf):
    """All raw documents as files of a drop folder, swept four times and ingested, reported per path and attempt.

    Every fifth file is half written at the first sweep. The last call finds nothing that was not dispatched.
    """
    work = scratch_dir(spark, "work")
    drop = f"{work}/drop"
    rows = all_docs(spark, sf).select(
        F.col("filename").alias("name"), F.encode("content", "utf-8").alias("content"), "file_size_bytes"
    )
    half = F.substring("content", F.lit(1), (F.col("file_size_bytes") / 2 + 1).cast("int"))
    slow = F.pmod(F.xxhash64("name"), F.lit(5)) == 0
    put_files(rows.select("name", F.when(slow, half).otherwise(F.col("content")).alias("content")), drop)
    intake = Intake(f"{work}/lake", f"{work}/records", ingest_date=TODAY)
    start = datetime(2025, 3, 1, tzinfo=timezone.utc)
    times = [start + timedelta(seconds=n) for n in range(5)]
    sweep_ingest(spark, drop, intake, work, times[:1])
    put_files(rows.where(slow).select("name", "content"), drop)
    sweep_ingest(spark, drop, intake, work, times[1:4])
    sweep_ingest(spark, drop, intake, work, times[4:])
    summary = intake.summaries(spark).withColumn("file_path", base_name(F.col("file_path")))
    return summary.select("file_path", "attempt", "status", "chunk_count", "token_total", "error_message")


def pipeline_search(spark, sf):
    """Documents to lake to search: a chunk of every page, as a query, finds a chunk of the same text with score 1."""
    root = scratch_dir(spark, "lake") + "/lake"
    ingest.ingest(html_docs(spark, sf), root, ingest_date=TODAY)
    stored = lake_scan(spark, root)
    probes = stored.groupBy("source_filename").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    queries = probes.withColumn("query_id", F.xxhash64("source_filename"))
    vectors = stored.select("chunk_id", "embedding")
    hits = retrieval.multi_query_search(vectors, queries, k=1).select("query_id", "similarity_score")
    found = queries.select("query_id", F.col("source_filename").alias("page")).join(hits, "query_id", "left")
    return found.select("page", F.round("similarity_score", 4).alias("similarity_score"))


QUERIES = {
    "lake_scan": scan,
    "write_lake": lake_write,
    "lake_search": lake_search,
    "search_bounded": bounded_search,
    "file_bounds": file_bounds,
    "prompt_search_stored": prompt_stored,
    "search_by_example_stored": example_stored,
    "embedding_check": embedding_check,
    "lake_files": files,
    "lake_stats": lake_stats,
    "lake_kpis": lake_kpis,
    "format_bytes": sizes,
    "write_complete": complete_writes,
    "dispatch_once": dispatch,
    "stream_ingest": streamed_intake,
    "pipeline_search": pipeline_search,
}

V = with_views("chunk_lake")
DATED = f"{V}, l AS (SELECT *, coalesce(filing_date, DATE '{TODAY}') AS d FROM chunk_lake)"
PATHS = "'domain=' || domain || strftime(d, '/year=%Y/month=%m/day=%d')"
UNITS = """CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024)
  WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576) ELSE printf('%.2f GB', size / 1073741824) END"""

ORACLES = {
    "lake_scan": f"""{DATED} SELECT chunk_id, domain, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day, filing_date
FROM l WHERE domain = 'finance'""",
    "write_lake": f"""{DATED} SELECT * EXCLUDE (d, embedding), year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day,
array_to_string(list_transform(embedding, lambda v: CAST(CAST(round(CAST(v AS DOUBLE) * 1e4) AS BIGINT) AS VARCHAR)), ',') AS embedding FROM l""",
    "lake_search": f"""{SCORED} SELECT chunk_id, filing_date, text, round(s, 6) AS similarity_score FROM (SELECT * FROM scored
WHERE domain = 'finance' AND filing_date BETWEEN DATE '2024-03-01' AND DATE '2024-09-30' ORDER BY s DESC, chunk_id LIMIT 15) WHERE s >= 0""",
    "file_bounds": f"""{SCORED} SELECT domain, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day, count(*) AS rows,
round(max(s), 6) AS best, true AS holds FROM (SELECT *, coalesce(filing_date, DATE '{TODAY}') AS d FROM scored) GROUP BY ALL""",
    "prompt_search_stored": RANKED["prompt_search"],
    "search_by_example_stored": RANKED["search_by_example"],
    "embedding_check": f"""{V}, m AS (SELECT chunk_id FROM chunk_lake WHERE CAST(substr(chunk_id, 2, 9) AS INT) % 10 IN (3, 4))
SELECT count(*) AS missing, array_to_string(list(chunk_id ORDER BY chunk_id)[1:3], ',') AS examples FROM m""",
    "lake_files": f"""{DATED} SELECT DISTINCT domain, strftime(d, '%Y') AS year, strftime(d, '%m') AS month, strftime(d, '%d') AS day, true AS well_formed FROM l""",
    "lake_stats": f"""{DATED} SELECT count(DISTINCT {PATHS}) AS total_parquet_files, true AS has_bytes,
string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, string_agg(DISTINCT {PATHS}, ',' ORDER BY {PATHS}) AS partitions FROM l""",
    "lake_kpis": f"""{DATED} SELECT count(DISTINCT {PATHS}) AS total_files, true AS total_bytes, count(DISTINCT domain) AS domains,
count(DISTINCT {PATHS}) AS partitions FROM l""",
    "format_bytes": f"""WITH o AS (SELECT o_orderkey, CAST(trunc(o_totalprice * pow(10.0, o_orderkey % 6)) AS BIGINT) AS size FROM orders)
SELECT o_orderkey, {UNITS} AS size_text,
  CASE WHEN size < 1048576 THEN {UNITS} ELSE printf('%.2f MB', size / 1048576) END AS item_text,
  CASE WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576) ELSE printf('%.2f GB', size / 1073741824) END AS volume_text FROM o""",
    "write_complete": f"""{with_views("file_observations")},
obs AS (SELECT path, event_id, size, epoch_us(observed_at) AS t,
  row_number() OVER (PARTITION BY path ORDER BY observed_at, event_id) AS n FROM file_observations WHERE size > 0),
st AS (SELECT path, n, event_id, size, size AS seen, t AS last, 0 AS cnt, true AS alive, false AS done FROM obs WHERE n = 1
  UNION ALL SELECT path, n, event_id, size, CASE WHEN alive AND early THEN seen ELSE size END, CASE WHEN alive AND early THEN last ELSE t END,
    CASE WHEN NOT alive THEN 0 WHEN early THEN cnt WHEN size = seen THEN cnt + 1 ELSE 0 END,
    NOT (alive AND NOT early AND size = seen AND cnt + 1 >= 2), alive AND NOT early AND size = seen AND cnt + 1 >= 2
  FROM (SELECT o.path, o.n, o.event_id, o.size, o.t, s.seen, s.last, s.cnt, s.alive, o.t - s.last < 3600000000 AS early
        FROM st s JOIN obs o ON o.path = s.path AND o.n = s.n + 1))
SELECT path, event_id, size FROM st WHERE done""",
    "dispatch_once": f"""{with_views("file_observations")}, latest AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id)
SELECT DISTINCT path FROM file_observations WHERE path NOT IN (SELECT 'f' || user_id || '.htm' FROM latest WHERE kind = 'click')""",
    "stream_ingest": f"""{SLICED}, n AS (
  SELECT doc_id, count(*) AS chunk_count, CAST(sum({tokens_sql("s.text")}) AS BIGINT) AS token_total FROM slices s JOIN whole USING (key) GROUP BY doc_id)
SELECT filename AS file_path, 1 AS attempt, CASE WHEN n.doc_id IS NULL THEN 'failed' ELSE 'completed' END AS status,
  coalesce(chunk_count, 0) AS chunk_count, coalesce(token_total, 0) AS token_total,
  CASE WHEN n.doc_id IS NULL THEN 'malformed JSON: ' || filename END AS error_message
FROM docs LEFT JOIN n ON n.doc_id = docs.filename""",
    "pipeline_search": f"""{CHUNKS} SELECT DISTINCT doc_id AS page, 1.0::DOUBLE AS similarity_score FROM chunks
WHERE doc_id IN (SELECT filename FROM raw_html)""",
}
ORACLES["search_bounded"] = ORACLES["lake_search"]
