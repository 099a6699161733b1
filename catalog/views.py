"""Inputs derived from the given tables; the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

# One chunk per document; vectors are dealt out in turn, so none is used much more often than another.
CHUNK_LAKE = """
SELECT concat('c', lpad(CAST(d.doc_id AS STRING), 9, '0')) AS chunk_id,
       concat('d', CAST(d.doc_id AS STRING)) AS doc_id,
       CASE e.label % 3 WHEN 0 THEN 'finance' WHEN 1 THEN 'literature' ELSE 'general' END AS domain,
       concat(d.source, '_', CAST(d.doc_id AS STRING), '.htm') AS source_filename,
       CASE d.doc_id % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '8-K' WHEN 3 THEN 'BOOK' ELSE 'MISC' END
         AS form_type,
       CASE WHEN d.doc_id % 50 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(d.doc_id * 7 % 366 AS INT) END AS filing_date,
       CASE d.doc_id % 3 WHEN 0 THEN 'General' WHEN 1 THEN 'Item 1A - Risk Factors' ELSE 'Chapter 1 - Loomings' END
         AS section,
       d.doc_id % 4 = 0 AS is_table,
       d.text AS text,
       e.embedding AS embedding,
       CASE WHEN d.doc_id % 25 = 0 THEN 'not json'
            ELSE concat('{"page_number": ', CAST(d.doc_id % 90 + 1 AS STRING), '}') END AS metadata_json
FROM (SELECT *, doc_id % (SELECT count(*) FROM embeddings) AS pick FROM documents) d JOIN embeddings e ON e.vec_id = d.pick
"""

RAW_TEXT = """
SELECT doc_id AS doc_no,
       concat(source, CASE doc_id % 4 WHEN 0 THEN '_10-k_' WHEN 1 THEN '_10-Q_' WHEN 2 THEN '_8-K_' ELSE '_' END,
              CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.htm' ELSE '.txt' END) AS filename,
       concat(CASE doc_id % 5 WHEN 0 THEN concat('Item 1A. Risk Factors', chr(10), chr(10))
                              WHEN 1 THEN concat('ITEM 7: Management', chr(10), chr(10))
                              WHEN 2 THEN concat('Chapter 3. Loomings', chr(10), chr(10))
                              WHEN 3 THEN concat('Part iv', chr(10), chr(10)) ELSE '' END,
              replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10),
              'Item 99. Other matters', chr(10), chr(10), 'Closing line.') AS content
FROM documents
"""

RAW_HTML = """
SELECT page_id AS doc_no, concat('page_', CAST(page_id AS STRING), '.htm') AS filename,
       CASE WHEN page_id % 3 = 0
            THEN replace(html, '</article>', concat('<h2>Item 8. Financial Statements</h2><table><tr><th>k</th><th>v</th></tr>',
                 repeat('<tr><td>Revenue</td><td>60,922</td></tr>', CAST(page_id % 60 AS INT)), '</table></article>'))
            ELSE html END AS content
FROM pages
"""

RAW_JSON = """
SELECT concat('conv_', CAST(conv_id AS STRING), '_', CAST(turn AS STRING), '.json') AS filename,
       CASE conv_id % 3 WHEN 0 THEN concat('{', CASE WHEN conv_id % 2 = 0 THEN '"title": "old", ' ELSE '' END, '"title": "', role, ' ', CAST(conv_id AS STRING), '", "content": "turn ', CAST(turn AS STRING), '"}')
                        WHEN 1 THEN concat('["', role, '", "turn ', CAST(turn AS STRING), '"]')
                        ELSE '{"title": ' END AS content
FROM conversations
"""

SIDECARS = """
SELECT concat(CASE WHEN doc_id % 2 = 0 THEN filename ELSE substr(filename, 1, length(filename) - 4) END, '.meta.json')
         AS sidecar_name,
       CASE WHEN doc_id % 7 = 0 THEN '{"doc_id": '
            WHEN doc_id % 11 = 0 THEN '{"ticker": "NOID"}'
            ELSE concat('{"doc_id": "acc-', CAST(doc_id AS STRING), '", "source_filename": "other.htm", "domain": "',
                        CASE WHEN doc_id % 5 = 0 THEN 'literature' ELSE 'finance' END,
                        '", "form_type": "10-K", "filing_date": "2024-02-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'),
                        '", "ticker": "T', CAST(doc_id % 90 AS STRING), '"}') END AS body
FROM (SELECT doc_no AS doc_id, filename FROM raw_text) r
WHERE doc_id % 3 <> 2
"""

# One observed file per user; its size changes every few days.
FILE_OBSERVATIONS = """
SELECT concat('f', CAST(user_id AS STRING), '.htm') AS path, ts AS observed_at, event_id,
       CAST(floor(((year(ts) * 12 + month(ts)) * 31 + day(ts) + user_id) / 12.0) AS BIGINT) % 50 AS size
FROM events
"""

QUEUE = """
SELECT concat(d.source, '_', CAST(d.doc_id AS STRING), '.htm') AS filename,
       CASE WHEN l.doc_id IS NULL THEN 'PENDING' WHEN l.toxic = 1 THEN 'FAILED' ELSE 'PROCESSED' END AS status,
       d.n_chars AS file_size_bytes, 1704067200 + d.doc_id * 60 AS mtime,
       CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE upper(d.lang) END AS ticker,
       CASE d.doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE NULL END AS form_type
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

FILINGS = """
SELECT upper(replace(c.c_name, '#', '_')) AS ticker, lpad(CAST(c.c_custkey AS STRING), 10, '0') AS cik, c.c_name AS title,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '10-Q' ELSE '10-K' END AS form,
       CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS filing_date,
       CAST(CAST(o.o_orderdate AS DATE) - CAST(o.o_orderkey % 40 AS INT) AS STRING) AS report_date,
       concat(lpad(CAST(c.c_custkey AS STRING), 10, '0'), '-24-', lpad(CAST(o.o_orderkey % 1000000 AS STRING), 6, '0')) AS accession,
       concat('doc', CAST(o.o_orderkey AS STRING), CASE WHEN o.o_orderkey % 7 = 0 THEN '' ELSE '.htm' END) AS primary_document,
       o.o_orderkey AS position
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
"""

# One submissions document per order, with arrays of unequal length.
SUBMISSIONS = """
SELECT o_orderkey AS order_no,
       concat('{"cik": "', CAST(o_custkey AS STRING), '", "name": "n", "filings": {"recent": {"form": ["10-K", "10-Q", "8-K"], ',
              '"filingDate": ["', CAST(CAST(o_orderdate AS DATE) AS STRING), '"], "reportDate": [',
              CASE WHEN o_orderkey % 2 = 0 THEN '"2024-01-01", "2024-02-02"' ELSE '' END,
              '], "accessionNumber": ["a', CAST(o_orderkey AS STRING), '", "b"], "primaryDocument": ["x.htm", "y.htm", "z.htm"]}}}')
         AS body
FROM orders
"""

# One ticker object of two entries per customer.
TICKERS = """
SELECT concat('{"0": {"cik_str": ', CAST(c_custkey AS STRING), ', "ticker": " cust', CAST(c_custkey AS STRING),
              ' ", "title": "', c_name, '"}, "1": {"cik_str": ', CAST(c_custkey + 1000000 AS STRING), ', "ticker": "alt',
              CAST(c_custkey AS STRING), '", "title": "', c_mktsegment, '"}}') AS body
FROM customer
"""

VIEWS = {
    "chunk_lake": CHUNK_LAKE,
    "raw_text": RAW_TEXT,
    "raw_html": RAW_HTML,
    "raw_json": RAW_JSON,
    "sidecars": SIDECARS,
    "file_observations": FILE_OBSERVATIONS,
    "queue": QUEUE,
    "filings": FILINGS,
    "submissions": SUBMISSIONS,
    "tickers": TICKERS,
}
NEEDS = {"sidecars": ("raw_text",)}


def with_views(*names: str) -> str:
    """A WITH clause defining views and the views they need."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*NEEDS.get(name, ()), name) if n not in wanted]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    for other in (*TABLES, *VIEWS):
        if f" {other}" in text and other != name:
            source = view(spark, sf_dir, other) if other in VIEWS else table(spark, sf_dir, other)
            source.createOrReplaceTempView(other)
    return spark.sql(text)
