"""Search, presentation and console queries over the chunk view."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import TABLES, table, view, with_views
from quire.functions.text import WHITESPACE
from quire.functions.vectors import hash_vector
from quire.operators import presentation, retrieval
from quire.operators.evaluation import class_eval, evaluation_summary
from quire.plans.ask import Request, answer, ask, request_error
from quire.plans.console import read_only_sql

PROMPT = "revenue growth and operating income"
# A twelve-digit text of the prompt vector serves both engines.
PROMPT_SQL = "[" + ", ".join(f"{v:.12f}" for v in hash_vector(PROMPT, 64)) + "]::DOUBLE[]"
PROMPT_VECTOR = [round(v, 12) for v in hash_vector(PROMPT, 64)]
EXAMPLE = ["Tion and", "the by"]
BLANK_SQL = "'" + WHITESPACE + "'"


def lake(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "chunk_lake")


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def query_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity_score", F.round("similarity_score", 6))


def cosine(spark, sf):
    scored = retrieval.with_cosine(lake(spark, sf), query_vector(spark, sf))
    return rounded(scored.select("chunk_id", "similarity_score"))


def metadata_filter(spark, sf):
    rows = retrieval.metadata_filter(
        lake(spark, sf), "finance", "10-K", date(2024, 2, 1), date(2024, 11, 30), is_table_only=True
    )
    return rows.select("chunk_id", "domain", "form_type", "filing_date")


def threshold(spark, sf):
    scored = retrieval.with_cosine(lake(spark, sf), query_vector(spark, sf)).select("chunk_id", "similarity_score")
    return rounded(retrieval.threshold(retrieval.top_k(scored, 100), 0.1))


def top_k(spark, sf):
    scored = retrieval.with_cosine(lake(spark, sf), query_vector(spark, sf)).select("chunk_id", "similarity_score")
    return rounded(retrieval.top_k(scored, 25))


def search_hits(spark, sf, k=20):
    return retrieval.search(
        lake(spark, sf), query_vector(spark, sf), start_date=date(2024, 1, 15), k=k, similarity_threshold=0.0
    )


def search(spark, sf):
    return rounded(search_hits(spark, sf)).drop("metadata_json")


def parse_metadata(spark, sf):
    parsed = presentation.parse_metadata(F.col("metadata_json"))
    rows = lake(spark, sf).select("chunk_id", parsed.alias("m"))
    return rows.select("chunk_id", F.col("m")["page_number"].alias("page_number"), F.col("m")["raw"].alias("raw"))


def citations(spark, sf):
    return presentation.citations(search_hits(spark, sf))


def grounded_digest(spark, sf):
    queries = query_table(spark, sf)
    everything = lake(spark, sf).where("form_type <> 'MISC'")
    hits = retrieval.multi_query_search(everything, queries, 5).where("similarity_score >= 0.2")
    return presentation.grounded_digest(hits, queries)


def score_band(spark, sf):
    scored = retrieval.with_cosine(lake(spark, sf), query_vector(spark, sf)).select("chunk_id", "similarity_score")
    return rounded(presentation.with_score_band(scored.withColumn("similarity_score", F.abs("similarity_score") * 2.2)))


def result_table(spark, sf):
    return presentation.result_table(search_hits(spark, sf))


def search_by_example(spark, sf):
    hits = retrieval.search_by_example(lake(spark, sf), EXAMPLE)
    return hits.withColumn("cosine_similarity", F.round("cosine_similarity", 4))


def prompt_search(spark, sf):
    return retrieval.prompt_search(lake(spark, sf), PROMPT_VECTOR)


def multi_query_search(spark, sf):
    hits = retrieval.multi_query_search(lake(spark, sf).select("chunk_id", "embedding"), query_table(spark, sf), 10)
    return rounded(hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "similarity_score"))


def evaluation(spark, sf):
    """Chunks of the query's own domain and form are its truth set."""
    chunks = lake(spark, sf)
    queries = query_table(spark, sf)
    hits = retrieval.multi_query_search(chunks.select("chunk_id", "embedding"), queries, 10)
    classes = chunks.select("chunk_id", F.concat_ws("/", "domain", "form_type").alias("class"))
    # A query's own row names its class.
    named = classes.select(F.substring("chunk_id", 2, 9).cast("bigint").alias("query_id"), "class")
    result = class_eval(hits, classes, named.join(queries.select("query_id"), "query_id", "left_semi"), 0.1, 0.01)
    return result.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def evaluation_gate(spark, sf):
    """Means over the query set against the thresholds."""
    row = evaluation_summary(evaluation(spark, sf), 0.1, 0.01)
    return row.withColumns({c: F.round(c, 4) for c in ("mean_precision", "mean_recall")})


def ask_lake(spark, sf):
    request = Request(PROMPT, domain=None, top_k=10, similarity_threshold=-1.0)
    return rounded(ask(lake(spark, sf), request, 64).select("chunk_id", "source_filename", "similarity_score"))


def answer_question(spark, sf):
    request = Request(PROMPT, domain="finance", top_k=5)
    return answer(ask(lake(spark, sf), request, 64), request)


def request_checks(spark, sf):
    """One search request per event and per conversation turn: question, k and threshold from the row."""
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("request_id"),
        F.col("text").alias("question"),
        (F.col("turn") * 40 - 20).alias("k"),
        F.lit(0.0).alias("t"),
    )
    events = table(spark, sf, "events").select(
        F.concat_ws("-", F.lit("event"), "event_id").alias("request_id"),
        F.when(F.col("event_type") != "purchase", F.col("event_type")).otherwise("").alias("question"),
        (F.col("user_id") % 130).alias("k"),
        (F.col("value") / 50.0 - 1.0).alias("t"),
    )
    error = request_error(F.col("question"), F.col("k"), F.col("t"))
    return turns.unionByName(events).select("request_id", error.alias("error"))


CONSOLE_SQL = """
SELECT n.n_name AS nation, p.p_type AS part_type, count(*) AS lines,
       CAST(round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS DOUBLE) AS revenue
FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE l.l_quantity > {quantity} AND o.o_orderstatus = {status}
GROUP BY n.n_name, p.p_type
"""


def console_sql(spark, sf):
    tables = {t: table(spark, sf, t) for t in TABLES}
    return read_only_sql(spark, CONSOLE_SQL.format(quantity="?", status="?"), [10, "O"], tables)


def tabular_chunks(spark, sf):
    return presentation.tabular_chunks(lake(spark, sf))


def count_by_domain(spark, sf):
    return presentation.count_by_domain(lake(spark, sf))


def dated(spark, sf):
    return lake(spark, sf).withColumn("year", F.year("filing_date").cast("bigint"))


def dist_year_form(spark, sf):
    return presentation.distribution(dated(spark, sf))


def dist_year(spark, sf):
    return presentation.distribution(dated(spark, sf), ("domain", "year"))


QUERIES = {
    "search": search,
    "cosine": cosine,
    "metadata_filter": metadata_filter,
    "threshold": threshold,
    "top_k": top_k,
    "parse_metadata": parse_metadata,
    "citations": citations,
    "grounded_digest": grounded_digest,
    "score_band": score_band,
    "result_table": result_table,
    "search_by_example": search_by_example,
    "tabular_chunks": tabular_chunks,
    "count_by_domain": count_by_domain,
    "dist_year_form": dist_year_form,
    "dist_year": dist_year,
    "prompt_search": prompt_search,
    "read_only_sql": console_sql,
    "request_checks": request_checks,
    "multi_query_search": multi_query_search,
    "retrieval_eval": evaluation,
    "evaluation_summary": evaluation_gate,
    "ask": ask_lake,
    "answer": answer_question,
}

V = with_views("chunk_lake")
SCORED = f"""{V}, q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
scored AS (SELECT c.*, list_cosine_similarity(c.embedding::DOUBLE[], q.qe::DOUBLE[]) AS s FROM chunk_lake c, q)"""
HITS = f"""{SCORED}, hits AS (
  SELECT * FROM (SELECT * FROM scored WHERE domain = 'finance' AND filing_date >= DATE '2024-01-15'
                 ORDER BY s DESC, chunk_id LIMIT 20) WHERE s >= 0)"""
PAIRS = f"""{V}, q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (SELECT q.query_id, c.*, list_cosine_similarity(c.embedding::DOUBLE[], q.qe::DOUBLE[]) AS s FROM chunk_lake c, q)"""
PROMPTED = f"""{V}, scored AS (SELECT *, list_cosine_similarity(embedding::DOUBLE[], {PROMPT_SQL}) AS s FROM chunk_lake)"""


def digest_sql(lines: str) -> str:
    return f"""'Grounded analysis based on ' || len({lines}) || ' retrieved context chunks from ' ||
  array_to_string(firsts[1:3], ', ') || ':' || chr(10) || chr(10) ||
  array_to_string(list_transform({lines}[1:3], lambda x: '• [' || x.section || ' // Score: ' || printf('%.4f', x.s) || ']: '
    || trim(substr(x.text, 1, 200), {BLANK_SQL}) || '...'), chr(10)) || chr(10) || chr(10) ||
  'Primary attribution grounded in ' || {lines}[1].source_filename || ' (' || {lines}[1].section || ').'"""


FIRSTS = """list_filter(list_transform(lines, lambda x: x.source_filename),
    lambda f, i: list_position(list_transform(lines, lambda x: x.source_filename), f) = i)"""

ORACLES = {
    "search": f"{HITS} SELECT chunk_id, source_filename, section, text, is_table, form_type, filing_date, round(s, 6) AS similarity_score FROM hits",
    "cosine": f"{SCORED} SELECT chunk_id, round(s, 6) AS similarity_score FROM scored",
    "metadata_filter": f"""{V} SELECT chunk_id, domain, form_type, filing_date FROM chunk_lake
WHERE domain = 'finance' AND form_type = '10-K' AND filing_date BETWEEN DATE '2024-02-01' AND DATE '2024-11-30' AND is_table""",
    "threshold": f"""{SCORED} SELECT chunk_id, round(s, 6) AS similarity_score FROM
(SELECT * FROM scored ORDER BY s DESC, chunk_id LIMIT 100) WHERE s >= 0.1""",
    "top_k": f"{SCORED} SELECT chunk_id, round(s, 6) AS similarity_score FROM scored ORDER BY s DESC, chunk_id LIMIT 25",
    "parse_metadata": f"""{V} SELECT chunk_id, CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.page_number') END AS page_number,
CASE WHEN NOT json_valid(metadata_json) THEN metadata_json END AS raw FROM chunk_lake""",
    "citations": f"""{HITS} SELECT source_filename, section, chunk_id, round(s, 4) AS similarity_score,
trim(substr(text, 1, 280), {BLANK_SQL}) || CASE WHEN length(text) > 280 THEN '...' ELSE '' END AS excerpt FROM hits""",
    "grounded_digest": f"""{PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r
  FROM pairs WHERE form_type <> 'MISC'),
kept AS (SELECT query_id, list(struct_pack(source_filename, section, s, text) ORDER BY r) AS lines
  FROM ranked WHERE r <= 5 AND s >= 0.2 GROUP BY query_id),
named AS (SELECT *, {FIRSTS} AS firsts FROM kept)
SELECT q.query_id, coalesce(len(lines), 0) AS hits, CASE WHEN lines IS NULL THEN
  'No relevant context chunks were located in the lakehouse for domain ''finance'' matching the query and active metadata filters.'
  ELSE {digest_sql("lines")} END AS answer FROM q LEFT JOIN named n ON n.query_id = q.query_id""",
    "score_band": f"""{SCORED}, x AS (SELECT chunk_id, abs(s) * 2.2 AS v FROM scored)
SELECT chunk_id, round(v, 6) AS similarity_score, round(v * 100.0, 1) AS percent,
CASE WHEN v >= 0.8 THEN 'high' WHEN v >= 0.6 THEN 'moderate' ELSE 'low' END AS band FROM x""",
    "result_table": f"""{HITS} SELECT '#' || row_number() OVER (ORDER BY s DESC, chunk_id) AS rank, printf('%.4f', s) AS similarity,
source_filename, section, CASE WHEN is_table THEN 'Table' ELSE 'Prose' END AS kind,
replace(substr(text, 1, 150), chr(10), ' ') || '...' AS excerpt FROM hits""",
    "search_by_example": f"""{V}, ref AS (SELECT embedding AS qe FROM chunk_lake WHERE contains(lower(text), 'tion and') OR contains(lower(text), 'the by') ORDER BY chunk_id LIMIT 1)
SELECT chunk_id, source_filename, section, is_table, round(s, 4) AS cosine_similarity, substr(text, 1, 140) AS excerpt FROM (
SELECT c.*, list_cosine_similarity(c.embedding::DOUBLE[], ref.qe::DOUBLE[]) AS s FROM chunk_lake c, ref) ORDER BY s DESC, chunk_id LIMIT 10""",
    "tabular_chunks": f"""{V} SELECT chunk_id, source_filename, section, length(text) AS char_length, text FROM chunk_lake
WHERE is_table ORDER BY chunk_id LIMIT 10""",
    "count_by_domain": f"{V} SELECT domain, count(*) AS chunk_count, count(DISTINCT source_filename) AS file_count FROM chunk_lake GROUP BY domain",
    "dist_year_form": f"{V} SELECT domain, year(filing_date) AS year, form_type, count(*) AS count FROM chunk_lake GROUP BY ALL",
    "dist_year": f"{V} SELECT domain, year(filing_date) AS year, count(*) AS count FROM chunk_lake GROUP BY ALL",
    "prompt_search": f"""{PROMPTED} SELECT chunk_id, source_filename, section, is_table, round(s, 4) AS cosine_similarity, substr(text, 1, 140) AS excerpt
FROM scored ORDER BY s DESC, chunk_id LIMIT 10""",
    "read_only_sql": CONSOLE_SQL.format(quantity="10", status="'O'"),
    "request_checks": """WITH r AS (
  SELECT concat_ws('-', 'turn', conv_id, turn) AS request_id, text AS question, turn * 40 - 20 AS k, 0.0::DOUBLE AS t FROM conversations
  UNION ALL SELECT concat_ws('-', 'event', event_id), CASE WHEN event_type <> 'purchase' THEN event_type ELSE '' END,
    user_id % 130, value / 50.0 - 1.0 FROM events)
SELECT request_id, CASE WHEN coalesce(question, '') = '' THEN 'question must not be empty'
  WHEN NOT k BETWEEN 1 AND 100 THEN 'top_k must be between 1 and 100'
  WHEN NOT t BETWEEN -1 AND 1 THEN 'similarity_threshold must be between -1 and 1' END AS error FROM r""",
    "multi_query_search": f"""{PAIRS} SELECT query_id, rank, chunk_id, round(s, 6) AS similarity_score FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM pairs) WHERE rank <= 10""",
    "retrieval_eval": f"""{PAIRS}, hits AS (SELECT query_id, chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM pairs) WHERE r <= 10),
truth AS (SELECT q.query_id, c.chunk_id FROM q JOIN chunk_lake own ON CAST(substr(own.chunk_id, 2, 9) AS BIGINT) = q.query_id
  JOIN chunk_lake c ON c.domain = own.domain AND c.form_type = own.form_type),
n AS (SELECT q.query_id, (SELECT count(*) FROM hits h WHERE h.query_id = q.query_id) AS retrieved,
  (SELECT count(*) FROM truth t WHERE t.query_id = q.query_id) AS relevant,
  (SELECT count(*) FROM hits h JOIN truth t USING (query_id, chunk_id) WHERE h.query_id = q.query_id) AS matched FROM q)
SELECT *, round(CASE WHEN retrieved = 0 THEN 0 ELSE matched / retrieved END, 6) AS precision,
  round(CASE WHEN relevant = 0 THEN 0 ELSE matched / relevant END, 6) AS recall,
  CASE WHEN retrieved = 0 OR relevant = 0 THEN false ELSE matched / retrieved >= 0.1 AND matched / relevant >= 0.01 END AS passed FROM n""",
    "ask": f"""{PROMPTED} SELECT chunk_id, source_filename, round(s, 6) AS similarity_score FROM scored ORDER BY s DESC, chunk_id LIMIT 10""",
    "answer": f"""{PROMPTED}, kept AS (SELECT list(struct_pack(source_filename, section, s, text) ORDER BY s DESC, chunk_id) AS lines
  FROM (SELECT * FROM scored WHERE domain = 'finance' ORDER BY s DESC, chunk_id LIMIT 5) WHERE s >= 0),
named AS (SELECT *, {FIRSTS} AS firsts FROM kept)
SELECT 0::BIGINT AS query_id, len(lines) AS hits, {digest_sql("lines")} AS answer FROM named""",
}
ORACLES["evaluation_summary"] = f"""SELECT count(*) AS queries, round(avg(precision), 4) AS mean_precision,
round(avg(recall), 4) AS mean_recall, avg(precision) >= 0.1 AND avg(recall) >= 0.01 AS passed FROM ({ORACLES["retrieval_eval"]})"""
