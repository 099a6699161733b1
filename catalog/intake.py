"""Queue, filing and record queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.documents import all_docs
from catalog.documents import CHUNKS, chunk_rows, text_docs
from catalog.views import table, view, with_views
from quire.operators import elements, filings, queue
from quire.sources import filings as indexes
from quire.sources import queue as listings
from quire.sources import records
from quire.sources.documents import spread
from quire.sources.scratch import numbered_files, put_files, scratch_dir


def ticker_index(spark, sf):
    return indexes.ticker_index(view(spark, sf, "tickers"))


def ticker_lookup(spark, sf):
    """Each order's customer looked up under a name that is sometimes unknown."""
    requests = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(" cust"), "o_custkey", F.lit(" ")).alias("ticker"),
    )
    found = indexes.lookup_tickers(requests, indexes.ticker_index(view(spark, sf, "tickers")))
    return found.select("o_orderkey", "ticker", "cik", "title")


def unknown_tickers(spark, sf):
    requests = table(spark, sf, "orders").select(
        F.concat(F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise("CUST"), "o_custkey").alias("ticker")
    )
    return indexes.unknown_tickers(requests, indexes.ticker_index(view(spark, sf, "tickers")))


def filing_index(spark, sf):
    rows = indexes.filing_index(view(spark, sf, "submissions"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


def selected(spark, sf):
    return filings.select_filings(
        view(spark, sf, "filings"), " 10-k ", start_date=date(1993, 1, 1), end_date="2030-12-31", limit=3
    )


def select_filings(spark, sf):
    return selected(spark, sf).select("ticker", "accession", "filing_date", "position")


def select_filings_year(spark, sf):
    rows = view(spark, sf, "filings")
    return filings.select_filings(rows, "10-Q", year=1997, limit=2).select("ticker", "accession", "report_date")


def filing_targets(spark, sf):
    rows = filings.filing_targets(view(spark, sf, "filings"))
    return rows.select("position", "document_url", "target_filename")


def date_presets(spark, sf):
    """Ranges as of order dates, moved to the present so that the fixed year has some."""
    day = F.add_months(F.to_date("o_orderdate"), 27 * 12)
    days = table(spark, sf, "orders").select("o_orderkey", day.alias("day"))
    return filings.with_presets(days, "day")


def queue_files(spark, sf):
    """The queue's documents written one per file into the three folders and listed again."""
    base = scratch_dir(spark, "queue")
    docs = spread(view(spark, sf, "queue")).select("status", F.repeat(F.lit("x"), F.col("file_size_bytes").cast("int")).alias("text"))
    folders = [status.lower() for status in listings.STATUSES]
    name, content = numbered_files(F.col("text"))
    placed = docs.where(F.col("status").isin(*listings.STATUSES)).select(F.concat_ws("/", F.lower("status"), name).alias("name"), content)
    put_files(placed, base, folders)
    files = listings.queue_files(spark, *[f"{base}/{f}" for f in folders]).where(F.col("filename").endswith(".txt"))
    # Each text file ends with one line end, which is not counted.
    return files.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col("file_size_bytes") - 1).alias("bytes")
    )


def queue_sources(spark, sf):
    """Queue view plus sidecars and error records made from its rows."""
    rows = view(spark, sf, "queue")
    n = ((F.col("mtime") - 1704067200) / 60).cast("bigint")
    files = rows.select("filename", "status", "file_size_bytes", "mtime")
    key = F.when(n % 2 == 0, F.col("filename")).otherwise(F.regexp_replace("filename", r"\.htm$", ""))
    body = F.when(n % 9 == 0, '{"ticker": ').otherwise(
        F.to_json(F.struct("ticker", "form_type", F.concat(F.lit("Company "), n).alias("company_name")))
    )
    sidecars = rows.where(n % 4 != 3).select("status", F.concat(key, F.lit(".meta.json")).alias("sidecar_name"), body.alias("body"))
    errors = rows.where((F.col("status") == "FAILED") & (n % 3 != 0)).select(
        "filename", F.lit("RuntimeError").alias("error_type"), F.concat(F.lit("failed at "), n).alias("error_message")
    )
    return files, sidecars, errors


def items(spark, sf):
    return queue.queue_items(*queue_sources(spark, sf))


def queue_items(spark, sf):
    return items(spark, sf)


def queue_filter(spark, sf):
    return queue.queue_filter(items(spark, sf), "processed", " 10-q ").select("filename", "status", "form_type", "ticker")


def queue_sort(spark, sf):
    ordered = queue.queue_sort(view(spark, sf, "queue").select("filename", "mtime"))
    return ordered


def queue_metrics(spark, sf):
    return queue.queue_metrics(view(spark, sf, "queue"))


def metadata_lookup(spark, sf):
    """Every file asked for with a hint that is right, wrong or missing."""
    files, sidecars, _ = queue_sources(spark, sf)
    n = ((F.col("mtime") - 1704067200) / 60).cast("bigint")
    hint = F.when(n % 3 == 0, F.col("status")).when(n % 3 == 1, "failed")
    requests = files.select("filename", hint.alias("status"))
    # The same sidecar name also lies in a second folder, with another body.
    second = sidecars.select(
        F.when(F.col("status") == "PENDING", "FAILED").otherwise("PENDING").alias("status"),
        "sidecar_name",
        F.lit('{"ticker":"SECOND"}').alias("body"),
    )
    return queue.metadata_lookup(requests, sidecars.unionByName(second))


def requeue(spark, sf):
    rows = items(spark, sf)
    names = table(spark, sf, "documents").where("doc_id % 2 = 0").select(
        F.concat("source", F.lit("_"), "doc_id", F.lit(".htm")).alias("filename")
    )
    return queue.requeue(rows, names).select("filename", "status", "attempt", "error_type", "error_message")


def unique_dest(spark, sf):
    """Documents moved under their source's name, a name many share; some names are taken."""
    moves = table(spark, sf, "documents").select(
        F.concat(F.lit("/in/"), "doc_id", F.lit("/"), "source", F.lit(".htm")).alias("path"),
        F.concat("source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("doc_id").cast("string")), F.lit(".htm")).alias("filename"),
    )
    existing = table(spark, sf, "documents").where("doc_id % 7 = 0").select(
        F.concat("source", "doc_id", F.lit(".htm")).alias("filename")
    )
    return queue.unique_dest(moves, existing)


def dead_letter(spark, sf):
    docs = elements.with_errors(elements.with_elements(all_docs(spark, sf)))
    letters = records.dead_letters(docs)
    return letters.select("source_filename", "file_size_bytes", "error_type", "error_message")


def ingest_summary(spark, sf):
    docs = elements.with_errors(elements.with_elements(all_docs(spark, sf)))
    stored = chunk_rows(spark, sf).select(
        F.col("doc_id").alias("source_filename"),
        "token_count",
        F.concat(F.lit("part-"), (F.col("position") % 2).cast("string")).alias("parquet_path"),
    )
    summary = records.ingest_summary(stored, records.dead_letters(docs))
    return summary.withColumn("parquet_paths", F.array_join("parquet_paths", ","))


def sidecar_records(spark, sf):
    """Sidecars of uploads, one per document."""
    uploads = text_docs(spark, sf).select(
        "filename",
        "content",
        F.when(F.length("content") % 2 == 0, F.lit(" abc ")).alias("ticker"),
        F.when(F.length("content") % 3 == 0, F.lit("10-K")).alias("form_type"),
        F.lit(None).cast("string").alias("domain"),
        F.to_date(F.lit("2024-05-06")).alias("uploaded_on"),
    )
    return records.upload_sidecars(uploads)


def filing_sidecars(spark, sf):
    targets = filings.filing_targets(selected(spark, sf)).withColumn("company_name", F.col("title"))
    return records.filing_sidecars(targets)


QUERIES = {
    "ticker_index": ticker_index,
    "ticker_lookup": ticker_lookup,
    "unknown_tickers": unknown_tickers,
    "filing_index": filing_index,
    "select_filings": select_filings,
    "select_filings_year": select_filings_year,
    "filing_targets": filing_targets,
    "date_presets": date_presets,
    "queue_files": queue_files,
    "queue_items": queue_items,
    "queue_filter": queue_filter,
    "queue_sort": queue_sort,
    "queue_metrics": queue_metrics,
    "metadata_lookup": metadata_lookup,
    "requeue": requeue,
    "unique_dest": unique_dest,
    "dead_letter": dead_letter,
    "ingest_summary": ingest_summary,
    "sidecar_records": sidecar_records,
    "filing_sidecars": filing_sidecars,
}

TICKER_ROWS = """idx AS (SELECT 'CUST' || c_custkey AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS title FROM customer
  UNION ALL SELECT 'ALT' || c_custkey, lpad(CAST(c_custkey + 1000000 AS VARCHAR), 10, '0'), c_mktsegment FROM customer)"""
F10K = """sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY position) AS r FROM filings
  WHERE form = '10-K' AND filing_date >= '1993-01-01' AND filing_date <= '2030-12-31') WHERE r <= 3)"""
TARGET = "ticker || '_' || form || '_' || replace(filing_date, '-', '') || '.htm'"
ITEMS = f"""{with_views("queue")}, q AS (SELECT *, (mtime - 1704067200) // 60 AS n FROM queue),
items AS (SELECT filename, status, file_size_bytes, mtime, CASE WHEN ok THEN ticker END AS ticker, CASE WHEN ok THEN form_type END AS form_type,
  CASE WHEN ok THEN 'Company ' || n END AS company_name, 'finance' AS domain,
  CASE WHEN bad THEN 'RuntimeError' END AS error_type, CASE WHEN bad THEN 'failed at ' || n END AS error_message, ok AS has_metadata, n
  FROM (SELECT *, n % 4 <> 3 AND n % 9 <> 0 AS ok, status = 'FAILED' AND n % 3 <> 0 AS bad FROM q))"""

ORACLES = {
    "ticker_index": f"WITH {TICKER_ROWS} SELECT * FROM idx",
    "ticker_lookup": f"""WITH {TICKER_ROWS}, r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NONE' ELSE 'CUST' END || o_custkey AS ticker FROM orders)
SELECT o_orderkey, r.ticker, cik, title FROM r LEFT JOIN idx ON idx.ticker = r.ticker""",
    "unknown_tickers": f"""WITH {TICKER_ROWS} SELECT DISTINCT t AS ticker FROM (
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'NONE' ELSE 'CUST' END || o_custkey AS t FROM orders) WHERE t NOT IN (SELECT ticker FROM idx)""",
    "filing_index": """SELECT o_orderkey AS order_no, CAST(o_custkey AS VARCHAR) AS cik, i - 1 AS position, ['10-K', '10-Q', '8-K'][i] AS form,
CASE WHEN i = 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '' END AS filing_date,
CASE WHEN o_orderkey % 2 = 0 THEN ['2024-01-01', '2024-02-02', ''][i] ELSE '' END AS report_date,
['a' || o_orderkey, 'b', ''][i] AS accession, ['x.htm', 'y.htm', 'z.htm'][i] AS primary_document FROM orders, range(1, 4) t(i)""",
    "select_filings": f"{with_views('filings')}, {F10K} SELECT ticker, accession, filing_date, position FROM sel",
    "select_filings_year": f"""{with_views('filings')} SELECT ticker, accession, report_date FROM (
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY position) AS r FROM filings
WHERE form = '10-Q' AND (filing_date LIKE '1997%' OR report_date LIKE '1997%')) WHERE r <= 2""",
    "filing_targets": f"""{with_views('filings')} SELECT position, 'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/' ||
replace(accession, '-', '') || '/' || primary_document AS document_url, {TARGET} AS target_filename FROM filings""",
    "date_presets": """SELECT o_orderkey, d AS day, d - 365 AS trailing_start, make_date(year(d), 1, 1) AS ytd_start, year(d) = 2024 AS fiscal_2024
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 27 YEAR AS DATE) AS d FROM orders)""",
    "queue_files": f"{with_views('queue')} SELECT status, count(*) AS files, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM queue GROUP BY status",
    "queue_items": f"{ITEMS} SELECT * EXCLUDE (n) FROM items",
    "queue_filter": f"""{ITEMS} SELECT filename, status, form_type, ticker FROM items WHERE status = 'PROCESSED' AND
contains(lower(filename) || ' ' || coalesce(lower(ticker), '') || ' ' || coalesce(lower(form_type), '') || ' ' || coalesce(lower(company_name), ''), '10-q')""",
    "queue_sort": f"{with_views('queue')} SELECT filename, mtime FROM queue",
    "queue_metrics": f"""{with_views('queue')} SELECT count(*) FILTER (WHERE status = 'PENDING') AS incoming_count,
count(*) FILTER (WHERE status = 'PROCESSED') AS processed_count, count(*) FILTER (WHERE status = 'FAILED') AS failed_count,
CAST(coalesce(sum(file_size_bytes) FILTER (WHERE status = 'PROCESSED'), 0) AS BIGINT) AS total_processed_bytes,
coalesce(round(100.0 * count(*) FILTER (WHERE status = 'FAILED') / nullif(count(*) FILTER (WHERE status <> 'PENDING'), 0), 2), 0)::DOUBLE AS failure_rate_pct,
strftime(make_timestamp(max(mtime) FILTER (WHERE status = 'PROCESSED') * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS latest_ingest_time FROM queue""",
    "metadata_lookup": f"""{ITEMS}, side AS (SELECT filename, status, CASE WHEN has_metadata THEN
    '{{' || concat_ws(',', '"ticker":"' || ticker || '"', '"form_type":"' || form_type || '"', '"company_name":"' || company_name || '"') || '}}' END AS body
    FROM items WHERE n % 4 <> 3),
  sc AS (SELECT * FROM side WHERE body IS NOT NULL UNION ALL
    SELECT filename, CASE WHEN status = 'PENDING' THEN 'FAILED' ELSE 'PENDING' END, '{{"ticker":"SECOND"}}' FROM side),
  req AS (SELECT filename, CASE WHEN n % 3 = 0 THEN status WHEN n % 3 = 1 THEN 'FAILED' END AS hint FROM items),
  ranked AS (SELECT req.filename, hint, sc.status, body, row_number() OVER (PARTITION BY req.filename ORDER BY CASE WHEN sc.status = hint THEN 0
    ELSE list_position(['PROCESSED', 'PENDING', 'FAILED'], sc.status) END) AS r FROM req JOIN sc ON sc.filename = req.filename)
SELECT req.filename, req.hint, status AS found_in, body FROM req LEFT JOIN (SELECT * FROM ranked WHERE r = 1) x ON x.filename = req.filename""",
    "requeue": f"""{ITEMS}, t AS (SELECT *, status = 'FAILED' AND n % 2 = 0 AS again FROM items)
SELECT filename, CASE WHEN again THEN 'PENDING' ELSE status END AS status, CASE WHEN again THEN 2 ELSE 1 END AS attempt,
CASE WHEN NOT again THEN error_type END AS error_type, CASE WHEN NOT again THEN error_message END AS error_message FROM t""",
    "unique_dest": """WITH m AS (SELECT '/in/' || doc_id || '/' || source || '.htm' AS path,
  source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END || '.htm' AS filename FROM documents),
f AS (SELECT *, min(path) OVER (PARTITION BY filename) AS first FROM m)
SELECT path, filename, CASE WHEN path = first AND filename NOT IN (SELECT source || doc_id || '.htm' FROM documents WHERE doc_id % 7 = 0)
  THEN filename ELSE regexp_replace(filename, '\\.htm$', '') || '_' || substr(sha256(path), 1, 16) || '.htm' END AS dest FROM f""",
    "dead_letter": f"""{with_views("raw_json")} SELECT filename AS source_filename, octet_length(encode(content)) AS file_size_bytes,
'DocumentParsingError' AS error_type, 'malformed JSON: ' || filename AS error_message
FROM raw_json WHERE NOT json_valid(content)""",
    "ingest_summary": f"""{CHUNKS} SELECT doc_id AS file_path, 'completed' AS status, count(*) AS chunk_count, CAST(sum(token_count) AS BIGINT) AS token_total,
string_agg(DISTINCT 'part-' || (position % 2), ',' ORDER BY 'part-' || (position % 2)) AS parquet_paths, NULL AS error_message FROM chunks GROUP BY doc_id
UNION ALL SELECT filename, 'failed', 0, 0, '', 'malformed JSON: ' || filename FROM docs WHERE filename LIKE '%.json' AND NOT json_valid(content)""",
    "sidecar_records": f"""{with_views("raw_text")} SELECT filename || '.meta.json' AS sidecar_name,
'{{"doc_id":"upload-' || substr(sha256(filename || ':' || substr(sha256(content), 1, 16)), 1, 12) || '","source_filename":"' || filename ||
'","domain":"finance","form_type":"' || CASE WHEN length(content) % 3 = 0 THEN '10-K' ELSE 'MISC' END || '","filing_date":"2024-05-06"' ||
CASE WHEN length(content) % 2 = 0 THEN ',"ticker":"ABC"' ELSE '' END || '}}' AS body FROM raw_text""",
    "filing_sidecars": f"""{with_views('filings')}, {F10K} SELECT {TARGET} || '.meta.json' AS sidecar_name,
'{{"doc_id":"' || accession || '","source_filename":"' || {TARGET} || '","domain":"finance","form_type":"' || form || '","filing_date":"' || filing_date ||
'","company_name":"' || title || '","ticker":"' || ticker || '","extra":{{"cik":"' || cik || '","report_date":"' || report_date ||
'","accession_number":"' || accession || '","primary_document":"' || primary_document || '"}}}}' AS body FROM sel""",
}
