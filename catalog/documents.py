"""Document parsing, chunking and embedding queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.retrieval import BLANK_SQL
from catalog.slices import SLICES
from catalog.views import table, view, with_views
from quire.functions.sections import section_of
from quire.functions.text import token_count
from quire.operators import chunking, elements, embedding, splitting
from quire.plans import console, ingest
from quire.sources import documents
from quire.sources.scratch import numbered_files, put_files, scratch_dir


def as_documents(raw: DataFrame) -> DataFrame:
    """A raw view in the shape of a file scan."""
    return raw.select(
        F.col("filename").alias("path"),
        "filename",
        F.octet_length("content").cast("bigint").alias("file_size_bytes"),
        elements.content_id(F.col("content")).alias("content_id"),
        "content",
    )


def text_docs(spark, sf):
    return documents.spread(as_documents(view(spark, sf, "raw_text")))


def html_docs(spark, sf):
    return documents.spread(as_documents(view(spark, sf, "raw_html")))


def json_docs(spark, sf):
    return documents.spread(as_documents(view(spark, sf, "raw_json")))


def all_docs(spark, sf):
    return text_docs(spark, sf).unionByName(html_docs(spark, sf)).unionByName(json_docs(spark, sf))


def exploded(docs: DataFrame) -> DataFrame:
    rows = chunking.explode_elements(elements.with_elements(docs).select("filename", "elements"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


def raw_scan(spark, sf):
    """Documents written one per file by Spark and scanned back as bytes.

    A file ends with a line end, so that byte is cut before comparing.
    """
    out = scratch_dir(spark, "raw")
    put_files(documents.spread(view(spark, sf, "raw_text").select("content")).select(*numbered_files(F.col("content"))), out)
    docs = documents.raw_scan(spark, out)
    text = F.substr("content", F.lit(1), F.length("content") - 1)
    return docs.select(
        elements.content_id(text).alias("content_id"),
        F.octet_length(text).cast("bigint").alias("file_size_bytes"),
        F.length(text).cast("bigint").alias("characters"),
    )


def intake_filter(spark, sf):
    """Every document and page name with changing endings, filtered by the intake's name and size rules."""
    endings = ["", ".meta.json", ".tmp", ".PART", ".HTML", ".pdf", ".docx"]
    names = view(spark, sf, "raw_text").select("filename", "doc_no").unionByName(
        view(spark, sf, "raw_html").select("filename", "doc_no")
    )
    listing = names.select(
        F.concat(
            F.lit("/in/"),
            F.when(F.col("doc_no") % 13 == 0, ".").otherwise(""),
            "filename",
            F.element_at(F.array(*map(F.lit, endings)), (F.col("doc_no") % 7 + 1).cast("int")),
        ).alias("path"),
        F.when(F.col("doc_no") % 17 == 0, 0).otherwise(F.col("doc_no") + 1).alias("length"),
    )
    return documents.intake_filter(listing)


def sidecar_resolve(spark, sf):
    rows = documents.sidecar_resolve(text_docs(spark, sf), view(spark, sf, "sidecars"))
    return rows.select("filename", "doc_id", "domain", "form_type", "filing_date", "ticker", "has_metadata")


def infer_form(spark, sf):
    names = view(spark, sf, "raw_text").select("filename").unionByName(view(spark, sf, "raw_html").select("filename"))
    return names.select("filename", elements.infer_form(F.col("filename")).alias("form_type"))


def content_id(spark, sf):
    return text_docs(spark, sf).select("filename", F.col("content_id").alias("doc_id"))


def validate_docs(spark, sf):
    docs = all_docs(spark, sf)
    # Every seventh document is emptied and every eleventh keeps blanks only.
    n = F.octet_length("filename") + F.col("file_size_bytes")
    content = F.when(n % 7 == 0, "").when(n % 11 == 0, " \n\n\t ").otherwise(F.col("content"))
    spoiled = docs.withColumn("content", content).withColumn("file_size_bytes", F.octet_length("content").cast("bigint"))
    checked = elements.with_errors(elements.with_elements(spoiled))
    return checked.select("filename", "file_size_bytes", "error_type", "error_message")


def format_dispatch(spark, sf):
    rows = exploded(all_docs(spark, sf))
    return rows.groupBy("filename", "category").agg(
        F.count(F.lit(1)).alias("elements"), F.sum(F.length("text")).alias("characters")
    )


def html_elements(spark, sf):
    return exploded(html_docs(spark, sf))


def text_elements(spark, sf):
    docs = text_docs(spark, sf).withColumn("filename", F.concat("filename", F.lit(".txt")))
    return exploded(docs).drop("html")


def json_elements(spark, sf):
    return exploded(json_docs(spark, sf)).drop("html")


def token_counts(spark, sf):
    """Tokens of every document, page, turn and benchmark text."""
    texts = [
        documents.spread(table(spark, sf, "documents")).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"),
        table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")),
        table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text"),
        table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text"),
    ]
    union = texts[0].unionByName(texts[1]).unionByName(texts[2]).unionByName(texts[3])
    return union.select("id", token_count(F.col("text")).alias("tokens"))


def element_rows(spark, sf):
    """Paragraphs of the text documents as rows."""
    docs = text_docs(spark, sf).withColumn("filename", F.concat("filename", F.lit(".txt")))
    return exploded(docs).select(F.col("filename").alias("doc_id"), "position", "text")


def section_detect(spark, sf):
    rows = element_rows(spark, sf)
    return rows.select("doc_id", "position", section_of(F.col("text")).alias("section")).where("section IS NOT NULL")


def section_cascade(spark, sf):
    return chunking.section_cascade(element_rows(spark, sf), block=16).select("doc_id", "position", "section")


def chunk_rows(spark, sf):
    docs = all_docs(spark, sf).withColumn("doc_id", F.col("filename"))
    parsed = chunking.with_sections(elements.with_elements(docs).select("doc_id", "elements"))
    return chunking.assemble_chunks(chunking.explode_elements(parsed))


def assemble_chunks(spark, sf):
    rows = chunk_rows(spark, sf)
    return rows.select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "section", "is_table", "text", "token_count", "chunk_id"
    )


def doc_metrics(spark, sf):
    return chunking.doc_metrics(chunk_rows(spark, sf))


def pack_metadata(spark, sf):
    rows = chunk_rows(spark, sf).withColumn("page_number", F.when(F.col("position") % 3 == 0, F.col("position") + 1))
    fields = ("element_type", "category", "table_html", "token_count", "page_number")
    return chunking.pack_metadata(rows, fields).select("chunk_id", "metadata_json")


LIMITS = splitting.Limits()


def split_rows(spark, sf):
    """Whole documents and tables as chunks, split."""
    rows = chunk_rows(spark, sf)
    whole = documents.spread(table(spark, sf, "documents")).select(
        F.concat(F.lit("whole-"), "doc_id").alias("doc_id"),
        F.lit(0).alias("position"),
        F.lit("General").alias("section"),
        F.lit("NarrativeText").alias("category"),
        "text",
        F.lit(False).alias("is_table"),
        F.lit(None).cast("string").alias("table_html"),
        token_count(F.col("text")).alias("token_count"),
        F.lit("NarrativeText").alias("element_type"),
        chunking.chunk_key(F.concat(F.lit("whole-"), "doc_id"), F.lit(0)).alias("chunk_id"),
    )
    return splitting.split_chunks(rows.unionByName(whole), LIMITS)


def split_text(spark, sf):
    """All slices with their bounds."""
    rows = split_rows(spark, sf)
    return rows.select(
        "doc_id",
        "position",
        "sub_chunk_index",
        "token_count",
        F.length("text").alias("characters"),
        F.sha2("text", 256).alias("text_hash"),
    )


def split_sql(spark, sf):
    """The slices of whole documents and tables by the splitter as a table function in a LATERAL join."""
    rows = chunk_rows(spark, sf).select("chunk_id", "text", "is_table").unionByName(
        documents.spread(table(spark, sf, "documents")).where("text IS NOT NULL").select(
            chunking.chunk_key(F.concat(F.lit("whole-"), "doc_id"), F.lit(0)).alias("chunk_id"), "text", F.lit(False).alias("is_table")
        )
    )
    splitting.register_splitter(spark, LIMITS)
    return console.read_only_sql(
        spark,
        """SELECT c.chunk_id, s.slice_index, length(s.slice) AS characters, sha2(s.slice, 256) AS text_hash
FROM texts c, LATERAL split_text(c.text, c.is_table) s""",
        tables={"texts": rows},
    )


def split_lineage(spark, sf):
    """Per parent: whether its slices are as many as stated, numbered in sequence, told apart, flagged and bounded."""
    rows = split_rows(spark, sf)
    parent = F.coalesce("parent_chunk_id", "chunk_id")
    slices = rows.groupBy(parent.alias("parent"), "doc_id").agg(
        F.count(F.lit(1)).alias("slices"),
        F.coalesce(F.max("total_sub_chunks"), F.lit(1)).alias("total"),
        F.coalesce(F.max("sub_chunk_index"), F.lit(0)).alias("last_index"),
        F.count_distinct("chunk_id").alias("ids"),
        F.bool_and("is_table").alias("is_table"),
        F.bool_and(F.coalesce(F.col("is_table_fragment") == F.col("is_table"), F.lit(True))).alias("flags_agree"),
        # An overlap tail may precede one more full unit.
        F.bool_and(F.length("text") <= 2 * LIMITS.max_characters).alias("bounded"),
    )
    n = F.col("slices")
    numbered = (n == F.col("total")) & (n == F.col("last_index") + 1) & (n == F.col("ids"))
    return slices.select("parent", "doc_id", "is_table", numbered.alias("numbered"), "flags_agree", "bounded")


def split_bounds(spark, sf):
    """Per parent, tables included: its slices, the characters of the longest, and the distinct words they keep."""
    rows = split_rows(spark, sf).withColumn("parent", F.coalesce("parent_chunk_id", "chunk_id"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))  # of one slice
    distinct = F.array_size(F.array_distinct(F.flatten(F.collect_list(words))))  # of one parent
    return rows.groupBy("parent", "doc_id", "is_table").agg(
        F.count(F.lit(1)).alias("slices"), F.max(F.length("text")).alias("longest"), distinct.alias("words")
    )


def micro(vector: str = "embedding"):
    """A vector as text of whole millionths: exact in every engine."""
    values = F.transform(vector, lambda v: F.round(v.cast("double") * 1e6).cast("bigint").cast("string"))
    return F.array_join(values, ",")


def hash_embed(spark, sf):
    """Raw double-precision hash vectors by built-in functions, over every document."""
    from quire.functions.vectors import hash_embedding

    rows = documents.spread(table(spark, sf, "documents")).select("doc_id", hash_embedding(F.col("text"), 64, False).alias("embedding"))
    return rows.select("doc_id", micro().alias("millionths"))


def l2_normalize(spark, sf):
    """Stored vectors scaled by their label, label 0 giving the zero vector, brought back to unit length."""
    from quire.functions.vectors import l2_normalize as unit

    scaled = F.transform("embedding", lambda v: v.cast("double") * F.col("label"))
    rows = table(spark, sf, "embeddings").select("vec_id", unit(scaled).alias("embedding"))
    return rows.select("vec_id", micro().alias("millionths"))


def profile_resolve(spark, sf):
    names = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ("Finance", "LITERATURE", "general ", "legal", ""))), (F.col("doc_id") % 5 + 1).cast("int"))).alias("domain")
    )
    resolved = embedding.resolve_profiles(names)
    return resolved.select("doc_id", "profile", F.col("dimension").cast("bigint").alias("dimension"), F.col("batch_size").cast("bigint").alias("batch_size"))


def embed_chunks(spark, sf):
    """Every document embedded with the profile of a domain set by its number."""
    domain = F.element_at(F.array(*map(F.lit, ("finance", "literature", "general"))), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("text"))
    rows = documents.spread(table(spark, sf, "documents")).select("doc_id", text.alias("text"), domain.alias("domain"))
    embedded = embedding.embed_chunks(rows)
    # Stored as float32, so four decimals of the scaled value are compared.
    values = F.transform("embedding", lambda v: F.round(v.cast("double") * 1e4).cast("bigint").cast("string"))
    return embedded.select("doc_id", F.size("embedding").cast("bigint").alias("dimension"), F.array_join(values, ",").alias("e4"))


def ingest_pipeline(spark, sf):
    """Documents to lake rows in one plan: metadata, elements, sections, splitting, balancing, packing, embedding."""
    parsed = ingest.parse(all_docs(spark, sf), view(spark, sf, "sidecars"))
    rows = ingest.lake_rows(ingest.chunk(parsed), date(2025, 3, 1))
    meta = F.col("metadata_json")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return rows.groupBy("source_filename", "doc_id", "domain", "form_type", "filing_date", "section").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.get_json_object(meta, "$.token_count").cast("bigint")).alias("tokens"),
        F.count_if("is_table").alias("tables"),
        F.count_if(F.get_json_object(meta, "$.is_split") == "true").alias("slices"),
        F.sum(F.size("embedding")).alias("dimensions"),
        F.count_if(F.abs(square - 1) < 1e-5).alias("unit_vectors"),
    )


QUERIES = {
    "raw_scan": raw_scan,
    "intake_filter": intake_filter,
    "sidecar_resolve": sidecar_resolve,
    "infer_form": infer_form,
    "content_id": content_id,
    "validate_docs": validate_docs,
    "format_dispatch": format_dispatch,
    "html_elements": html_elements,
    "text_elements": text_elements,
    "json_elements": json_elements,
    "token_count": token_counts,
    "section_detect": section_detect,
    "section_cascade": section_cascade,
    "assemble_chunks": assemble_chunks,
    "doc_metrics": doc_metrics,
    "pack_metadata": pack_metadata,
    "split_text": split_text,
    "split_sql": split_sql,
    "split_lineage": split_lineage,
    "split_bounds": split_bounds,
    "hash_embed": hash_embed,
    "l2_normalize": l2_normalize,
    "profile_resolve": profile_resolve,
    "embed_chunks": embed_chunks,
    "ingest_pipeline": ingest_pipeline,
}

W = r"[\s\p{Z}\x0B\x1c-\x1f\x85]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0B\x1c-\x1f\x85]"
TABLE = r"(?i)<table[\s\S]*?</table>"
TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "div")
BLOCK = "(?i)" + "|".join(rf"<{t}[\s\S]*?>[\s\S]*?</{t}>" for t in TAGS)
ITEM = rf"(?i)^{W}*item{W}+([0-9]{{1,2}}[A-Za-z]?)\.?{W}*[-–—:]?{W}*([^.\n]*)"
PART = rf"(?i)^{W}*part{W}+([IVXLCDM]+)\b"
CHAPTER = rf"(?i)^{W}*chapter{W}+(\d+|[A-Za-z]+)[:\-.\s\p{{Z}}\x0B\x1c-\x1f\x85]*([^\n]*)"


def strip_sql(text: str) -> str:
    return f"trim({text}, {BLANK_SQL})"


def plain_sql(markup: str) -> str:
    return f"trim(regexp_replace(regexp_replace({markup}, '<[^>]+>', ' ', 'g'), '{W}+', ' ', 'g'))"


def tokens_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))"


def section_sql(text: str) -> str:
    from quire.schema import ITEM_TITLES

    titles = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in ITEM_TITLES.items())
    item, part, chapter = (f"regexp_extract({text}, '{p}', 1)" for p in (ITEM, PART, CHAPTER))
    rest, title = (strip_sql(f"regexp_extract({text}, '{p}', 2)") for p in (ITEM, CHAPTER))
    return f"""CASE WHEN {item} <> '' THEN CASE upper({item}) {titles} ELSE 'Item ' || upper({item}) ||
    CASE WHEN {rest} = '' THEN '' ELSE ' - ' || {rest} END END
  WHEN {part} <> '' THEN 'Part ' || upper({part})
  WHEN {chapter} <> '' THEN 'Chapter ' || {chapter} || CASE WHEN {title} = '' THEN '' ELSE ' - ' || {title} END END"""


# The steps below are CTEs over ``docs(filename, content)``.
HTML_STEPS = f"""
hparts AS (SELECT filename, unnest(list_concat(list_transform(range(len(tables)), lambda i: [prose[i + 1], tables[i + 1]]), [[prose[len(tables) + 1]]])) AS pair,
    generate_subscripts(list_concat(list_transform(range(len(tables)), lambda i: [prose[i + 1], tables[i + 1]]), [[prose[len(tables) + 1]]]), 1) AS pn
  FROM (SELECT filename, regexp_split_to_array(content, '{TABLE}') AS prose, regexp_extract_all(content, '{TABLE}') AS tables
        FROM docs WHERE regexp_matches(filename, '(?i)\\.html?$'))),
hpart AS (SELECT filename, pn, unnest(pair) AS raw, generate_subscripts(pair, 1) AS side FROM hparts),
hclean AS (SELECT filename, pn, side, {strip_sql("raw")} AS part FROM hpart),
hblocks AS (SELECT filename, pn, side, part, lower(substr(part, 1, 6)) = '<table' AS t, regexp_extract_all(part, '{BLOCK}') AS found
  FROM hclean WHERE part <> ''),
hrows AS (
  SELECT filename, pn, side, 0 AS bn, 'Table' AS category, {plain_sql("part")} AS text, part AS html FROM hblocks WHERE t
  UNION ALL SELECT filename, pn, side, 0, 'NarrativeText', {plain_sql("part")}, NULL FROM hblocks WHERE NOT t AND len(found) = 0
  UNION ALL SELECT filename, pn, side, bn, CASE WHEN regexp_matches(b, '(?i)^<h') THEN 'Title' ELSE 'NarrativeText' END,
    {plain_sql("regexp_replace(b, '</[A-Za-z0-9]+>$', '')")}, NULL
  FROM (SELECT filename, pn, side, unnest(found) AS b, generate_subscripts(found, 1) AS bn FROM hblocks WHERE NOT t)),
hels AS (SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY pn, side, bn) - 1 AS position, category, text, html
  FROM hrows WHERE text <> '')"""
TEXT_STEPS = f"""
tparts AS (SELECT filename, unnest(ps) AS raw, generate_subscripts(ps, 1) AS pn FROM (
  SELECT filename, string_split(content, chr(10) || chr(10)) AS ps FROM docs WHERE NOT regexp_matches(filename, '(?i)\\.(html?|json)$'))),
tclean AS (SELECT filename, pn, {strip_sql("raw")} AS text FROM tparts),
tels AS (SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY pn) - 1 AS position,
  CASE WHEN length(text) < 80 AND right(text, 1) NOT IN ('.', ',', ';', ':') THEN 'Title' ELSE 'NarrativeText' END AS category,
  text, NULL::VARCHAR AS html FROM tclean WHERE text <> '')"""
JSON_STEPS = """
jdocs AS (SELECT filename, CASE WHEN json_valid(content) THEN replace(content, '{"title": "old", ', '{') END AS j FROM docs WHERE regexp_matches(filename, '(?i)\\.json$')),
jels AS (
  SELECT filename, 0 AS position, 'Title' AS category, j ->> '$.title' AS text, NULL::VARCHAR AS html FROM jdocs WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT filename, 1, 'NarrativeText', j ->> '$.content', NULL FROM jdocs WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT filename, generate_subscripts(items, 1) - 1, 'NarrativeText', unnest(items), NULL
    FROM (SELECT filename, json_extract_string(j, '$[*]') AS items FROM jdocs WHERE json_type(j) = 'ARRAY'))"""
ALL_STEPS = f"""{HTML_STEPS}, {TEXT_STEPS}, {JSON_STEPS},
els AS (SELECT * FROM hels UNION ALL SELECT * FROM tels UNION ALL SELECT * FROM jels)"""
ALL_DOCS = """docs AS (SELECT filename, content FROM raw_text UNION ALL SELECT filename, content FROM raw_html
  UNION ALL SELECT filename, content FROM raw_json)"""
TEXT_ONLY = "docs AS (SELECT filename || '.txt' AS filename, content FROM raw_text)"
CASCADE = """coalesce(last_value(sec IGNORE NULLS) OVER (PARTITION BY filename ORDER BY position
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'General')"""


def uuid_sql(key: str) -> str:
    h = f"sha256({key})"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


CHUNKS = f"""{with_views("raw_text", "raw_html", "raw_json")}, {ALL_DOCS}, {ALL_STEPS},
marked AS (SELECT *, {section_sql("text")} AS sec FROM els),
chunks AS (SELECT filename AS doc_id, position, {CASCADE} AS section, html IS NOT NULL AS is_table, coalesce(html, text) AS text,
  category, {tokens_sql("coalesce(html, text)")} AS token_count, {uuid_sql("filename || ':' || position")} AS chunk_id, html FROM marked)"""

#: Chunks and whole documents as the texts to split.
WHOLE = f"""{CHUNKS}, whole AS (
  SELECT chunk_id AS key, doc_id, position, is_table, text FROM chunks
  UNION ALL SELECT {uuid_sql("'whole-' || doc_id || ':0'")}, 'whole-' || doc_id, 0, false, text FROM documents WHERE text IS NOT NULL)"""

#: Chunks as an ingest splits them.
SLICED = f"""{CHUNKS}, whole AS (SELECT chunk_id AS key, doc_id, position, section, is_table, text FROM chunks), {SLICES}"""

MICRO = "array_to_string(list_transform({v}, lambda v: CAST(CAST(round(v * 1e6) AS BIGINT) AS VARCHAR)), ',')"


def hash_sql(key: str, text: str, dimension: str) -> str:
    """A query giving ``key`` and the scaled integers of the SHA-256 blocks as list ``e``; each block is hashed once."""
    word = " || ".join(f"substr(h[i // 8 + 1], (i % 8) * 8 + {7 - 2 * b}, 2)" for b in range(4))
    return f"""SELECT {key}, list_transform(range(dim), lambda i: CAST(CAST('0x' || {word} AS BIGINT) AS DOUBLE) / 4294967295.0 * 2.0 - 1.0) AS e
  FROM (SELECT {key}, dim, list_transform(range((dim + 7) // 8), lambda b: sha256(t || ':' || CAST(b AS VARCHAR))) AS h
        FROM (SELECT {key}, {text} AS t, {dimension} AS dim FROM documents))"""


SIDECAR_META = """
cand AS (SELECT r.filename, r.content, s.body, k FROM raw_text r CROSS JOIN (VALUES (0), (1)) c(k) JOIN sidecars s
  ON s.sidecar_name = (CASE k WHEN 0 THEN r.filename ELSE regexp_replace(r.filename, '\\.[^.]+$', '') END) || '.meta.json'
  WHERE json_valid(s.body) AND s.body ->> '$.doc_id' IS NOT NULL AND s.body ->> '$.source_filename' IS NOT NULL),
meta AS (SELECT filename, arg_min(body, k) AS m FROM cand GROUP BY filename)"""
FORM = """CASE WHEN contains(upper(filename), '10-K') THEN '10-K' WHEN contains(upper(filename), '10-Q') THEN '10-Q'
  WHEN contains(upper(filename), '8-K') THEN '8-K' WHEN regexp_matches(filename, '(?i)\\.txt$') OR contains(upper(filename), 'BOOK') THEN 'BOOK' ELSE 'MISC' END"""

ORACLES = {
    "raw_scan": f"""{with_views("raw_text")} SELECT substr(sha256(content), 1, 16) AS content_id,
  octet_length(encode(content)) AS file_size_bytes, length(content) AS characters FROM raw_text""",
    "intake_filter": f"""{with_views("raw_text", "raw_html")}, n AS (SELECT filename, doc_no FROM raw_text UNION ALL SELECT filename, doc_no FROM raw_html),
l AS (SELECT '/in/' || CASE WHEN doc_no % 13 = 0 THEN '.' ELSE '' END || filename ||
  ['', '.meta.json', '.tmp', '.PART', '.HTML', '.pdf', '.docx'][doc_no % 7 + 1] AS path,
  CASE WHEN doc_no % 17 = 0 THEN 0 ELSE doc_no + 1 END AS length FROM n)
SELECT * FROM l WHERE length > 0 AND regexp_matches(path, '(?i)\\.(pdf|html?|json|txt)$') AND NOT contains(path, '.meta.json') AND NOT contains(path, '/.')""",
    "sidecar_resolve": f"""{with_views("sidecars")}, {SIDECAR_META}
SELECT r.filename, coalesce(m ->> '$.doc_id', substr(sha256(r.content), 1, 16)) AS doc_id, coalesce(m ->> '$.domain', 'finance') AS domain,
  CASE WHEN m IS NULL THEN {FORM.replace("filename", "r.filename")} ELSE coalesce(m ->> '$.form_type', 'MISC') END AS form_type,
  CAST(m ->> '$.filing_date' AS DATE) AS filing_date, m ->> '$.ticker' AS ticker, m IS NOT NULL AS has_metadata
FROM raw_text r LEFT JOIN meta ON meta.filename = r.filename""",
    "infer_form": f"""{with_views("raw_text", "raw_html")} SELECT filename, {FORM} AS form_type
FROM (SELECT filename FROM raw_text UNION ALL SELECT filename FROM raw_html)""",
    "content_id": f"{with_views('raw_text')} SELECT filename, substr(sha256(content), 1, 16) AS doc_id FROM raw_text",
    "validate_docs": f"""{with_views("raw_text", "raw_html", "raw_json")}, d0 AS ({ALL_DOCS.split("AS (", 1)[1]},
d AS (SELECT filename, octet_length(encode(filename)) + octet_length(encode(content)) AS n, content FROM d0),
docs AS (SELECT filename, CASE WHEN n % 7 = 0 THEN '' WHEN n % 11 = 0 THEN ' ' || chr(10) || chr(10) || chr(9) || ' ' ELSE content END AS content FROM d),
{ALL_STEPS}, having_els AS (SELECT DISTINCT filename FROM els),
e AS (SELECT docs.filename, octet_length(encode(content)) AS file_size_bytes, CASE
  WHEN content = '' THEN 'empty document, 0 bytes: ' || docs.filename
  WHEN docs.filename LIKE '%.json' AND NOT json_valid(content) THEN 'malformed JSON: ' || docs.filename
  WHEN h.filename IS NULL THEN 'no content found: ' || docs.filename END AS error_message
  FROM docs LEFT JOIN having_els h ON h.filename = docs.filename)
SELECT *, CASE WHEN error_message IS NOT NULL THEN 'DocumentParsingError' END AS error_type FROM e""",
    "format_dispatch": f"""{with_views("raw_text", "raw_html", "raw_json")}, {ALL_DOCS}, {ALL_STEPS}
SELECT filename, category, count(*) AS elements, CAST(sum(length(text)) AS BIGINT) AS characters FROM els GROUP BY ALL""",
    "html_elements": f"{with_views('raw_html')}, docs AS (SELECT filename, content FROM raw_html), {HTML_STEPS} SELECT * FROM hels",
    "text_elements": f"{with_views('raw_text')}, {TEXT_ONLY}, {TEXT_STEPS} SELECT filename, position, category, text FROM tels",
    "json_elements": f"""{with_views('raw_json')}, docs AS (SELECT filename, content FROM raw_json), {JSON_STEPS}
SELECT filename, position, category, text FROM jels""",
    "token_count": f"""SELECT id, {tokens_sql("text")} AS tokens FROM (SELECT 'd' || doc_id AS id, text FROM documents
UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'b' || item_id, text FROM benchmark
UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)""",
    "section_detect": f"""{with_views('raw_text')}, {TEXT_ONLY}, {TEXT_STEPS}, s AS (
SELECT filename AS doc_id, position, {section_sql("text")} AS section FROM tels) SELECT * FROM s WHERE section IS NOT NULL""",
    "section_cascade": f"""{with_views('raw_text')}, {TEXT_ONLY}, {TEXT_STEPS}, s AS (SELECT filename, position, {section_sql("text")} AS sec FROM tels)
SELECT filename AS doc_id, position, {CASCADE} AS section FROM s""",
    "assemble_chunks": f"{CHUNKS} SELECT doc_id, position, section, is_table, text, token_count, chunk_id FROM chunks",
    "doc_metrics": f"""{CHUNKS} SELECT doc_id, count(*) AS chunk_count, CAST(sum(token_count) AS BIGINT) AS token_total,
count(*) FILTER (WHERE is_table) AS table_count FROM chunks GROUP BY doc_id""",
    "pack_metadata": f"""{CHUNKS} SELECT chunk_id, '{{"element_type":"' || category || '","category":"' || category || '"' ||
CASE WHEN is_table THEN ',"table_html":' || CAST(to_json(text) AS VARCHAR) ELSE '' END || ',"token_count":' || token_count ||
CASE WHEN position % 3 = 0 THEN ',"page_number":' || (position + 1) ELSE '' END || '}}' AS metadata_json FROM chunks""",
    "split_text": f"""{WHOLE}, {SLICES} SELECT doc_id, position, CASE WHEN total > 1 THEN n END AS sub_chunk_index,
  {tokens_sql("s.text")} AS token_count, length(s.text) AS characters, sha256(s.text) AS text_hash FROM slices s JOIN whole USING (key)""",
    "split_sql": f"""{WHOLE}, {SLICES} SELECT key AS chunk_id, n AS slice_index, length(text) AS characters, sha256(text) AS text_hash FROM slices""",
    "split_lineage": f"""{CHUNKS} SELECT chunk_id AS parent, doc_id, is_table, true AS numbered, true AS flags_agree, true AS bounded FROM chunks
UNION ALL SELECT {uuid_sql("'whole-' || doc_id || ':0'")}, 'whole-' || doc_id, false, true, true, true FROM documents""",
    "split_bounds": f"""{WHOLE}, {SLICES}, w AS (SELECT key, count(DISTINCT word) AS words FROM (
  SELECT key, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM slices) GROUP BY key)
SELECT key AS parent, doc_id, is_table, slices, longest, coalesce(words, 0) AS words
FROM (SELECT key, count(*) AS slices, max(length(text)) AS longest FROM slices GROUP BY key) JOIN whole USING (key) LEFT JOIN w USING (key)""",
    "hash_embed": f"SELECT doc_id, {MICRO.format(v='e')} AS millionths FROM ({hash_sql('doc_id', 'text', '64')})",
    "l2_normalize": f"""SELECT vec_id, {MICRO.format(v='list_transform(e, lambda x: CASE WHEN n > 1e-9 THEN x / n ELSE 1 / sqrt(len(e)) END)')} AS millionths
FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * label) AS e FROM embeddings))""",
    "profile_resolve": """SELECT doc_id, ['finance', 'literature', 'general', 'finance', 'finance'][doc_id % 5 + 1] AS profile,
[384, 768, 1024, 384, 384][doc_id % 5 + 1] AS dimension, [32, 16, 16, 32, 32][doc_id % 5 + 1] AS batch_size FROM documents""",
    "embed_chunks": f"""SELECT doc_id, len(e) AS dimension,
array_to_string(list_transform(e, lambda x: CAST(CAST(round(CAST(CAST(x / n AS FLOAT) AS DOUBLE) * 1e4) AS BIGINT) AS VARCHAR)), ',') AS e4
FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (
  {hash_sql("doc_id", "CASE WHEN doc_id % 50 = 0 THEN '__empty__' ELSE text END", "[384, 768, 1024][doc_id % 3 + 1]")}))""",
    "ingest_pipeline": f"""{SLICED}, {SIDECAR_META},
named AS (SELECT d.filename, m, coalesce(m ->> '$.doc_id', substr(sha256(d.content), 1, 16)) AS did FROM docs d LEFT JOIN meta ON meta.filename = d.filename),
every AS (SELECT w.doc_id AS source_filename, did AS doc_id, coalesce(m ->> '$.domain', 'finance') AS domain,
  CASE WHEN m IS NULL THEN {FORM.replace("filename", "w.doc_id")} ELSE coalesce(m ->> '$.form_type', 'MISC') END AS form_type,
  CAST(m ->> '$.filing_date' AS DATE) AS filing_date, section, {tokens_sql("s.text")} AS tokens, is_table, total > 1 AS cut
  FROM slices s JOIN whole w USING (key) JOIN named n ON n.filename = w.doc_id)
SELECT source_filename, doc_id, domain, form_type, filing_date, section, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens,
  count(*) FILTER (WHERE is_table) AS tables, count(*) FILTER (WHERE cut) AS slices,
  CAST(sum(CASE domain WHEN 'literature' THEN 768 ELSE 384 END) AS BIGINT) AS dimensions, count(*) AS unit_vectors
FROM every GROUP BY ALL""",
}
# The pipeline query needs the sidecar view too.
ORACLES["ingest_pipeline"] = ORACLES["ingest_pipeline"].replace(
    with_views("raw_text", "raw_html", "raw_json"), with_views("raw_text", "raw_html", "raw_json", "sidecars"), 1
)
