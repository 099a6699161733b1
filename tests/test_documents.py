import hashlib
import json
import re
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.sections import section_of
from quire.functions.text import WHITESPACE, decode_text, stem, strip, suffix, token_count
from quire.functions.vectors import hash_embedding, hash_vector, l2_normalize
from quire.operators import chunking, elements, embedding, splitting
from quire.plans import ingest
from quire.schema import PROFILES, Profile
from quire.sources import documents


def docs(spark, *files):
    rows = [(n, c, len(c.encode())) for n, c in files]
    df = spark.createDataFrame(rows, "filename string, content string, file_size_bytes bigint")
    return df.withColumn("content_id", elements.content_id(F.col("content")))


def cut(spark, name, content):
    rows = elements.with_elements(docs(spark, (name, content))).select(F.inline("elements")).collect()
    return [(r["category"], r["text"], r["html"]) for r in rows]


def test_white_space_set_is_pythons():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_text_helpers(spark):
    texts = ["", "  ", "a b", "x_1, y!", " 　é ü.\x85", "don't — stop", "กำ test"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", token_count(F.col("t")).alias("n"), strip(F.col("t")).alias("s")).collect()
    for r in got:
        assert r["s"] == r["t"].strip()
        assert r["n"] == len(re.findall(r"\w+|[^\w\s]", r["t"])) or "ำ" in r["t"]
    names = spark.createDataFrame([("a.tar.GZ",), (".hidden",), ("plain",), ("x.htm",)], "n string")
    assert [(r[0], r[1]) for r in names.select(suffix(F.col("n")), stem(F.col("n"))).collect()] == [
        (".GZ", "a.tar"), ("", ".hidden"), ("", "plain"), (".htm", "x"),
    ]


def test_decode_drops_bad_bytes_and_normalizes_line_ends(spark):
    df = spark.createDataFrame([(b"a\xff\r\nb\rc\xc3\xa9",)], "b binary")
    assert df.select(decode_text(F.col("b"))).first()[0] == "a\nb\ncé"


def test_html_elements(spark):
    html = (
        "<html><h1>Item 8. Financial  Statements</h1><p>Intro <b>bold</b> a < b</p>"
        "<table><tr><td>1</td></tr></table><div>tail</div><TABLE><tr></tr></TABLE>loose text<p></p>"
    )
    assert cut(spark, "f.htm", html) == [
        ("Title", "Item 8. Financial Statements", None),
        ("NarrativeText", "Intro bold a < b", None),
        ("Table", "1", "<table><tr><td>1</td></tr></table>"),
        ("NarrativeText", "tail", None),
    ]
    assert cut(spark, "f.html", "just <i>words</i> \n here") == [("NarrativeText", "just words here", None)]
    assert cut(spark, "f.html", "<table><tr><td>open") == [("Table", "open", "<table><tr><td>open")]


def test_text_and_json_elements(spark):
    assert cut(spark, "b.txt", "Chapter 1: Loomings\n\nCall me Ishmael.\n\n \n\n") == [
        ("Title", "Chapter 1: Loomings", None), ("NarrativeText", "Call me Ishmael.", None),
    ]
    assert cut(spark, "a.json", '{"title": "T", "content": "C"}') == [("Title", "T", None), ("NarrativeText", "C", None)]
    assert cut(spark, "a.json", '{"title": "", "name": "N", "content": 0, "body": "B"}') == [
        ("Title", "N", None), ("NarrativeText", "B", None),
    ]
    assert cut(spark, "a.json", '["x", {"k": 1}, true, null]') == [
        ("NarrativeText", "x", None), ("NarrativeText", '{"k":1}', None), ("NarrativeText", "True", None), ("NarrativeText", "None", None),
    ]
    assert cut(spark, "a.json", '"word"') == [("NarrativeText", "word", None)]
    assert cut(spark, "a.json", '{"k": [1]}\n') == [("NarrativeText", '{"k": [1]}', None)]


@pytest.mark.parametrize(
    "text, section",
    [
        ("Item 1A. Risk Factors", "Item 1A - Risk Factors"),
        ("ITEM 7: anything", "Item 7 - Management's Discussion and Analysis"),
        ("item 99 - Other matters. More", "Item 99 - Other matters"),
        ("Item 98", "Item 98"),
        ("Part iv", "Part IV"),
        ("Chapter 1: Loomings", "Chapter 1 - Loomings"),
        ("CHAPTER One", "Chapter One"),
        ("An item 5", None),
        ("", None),
    ],
)
def test_section_names(spark, text, section):
    assert spark.createDataFrame([(text,)], "t string").select(section_of(F.col("t"))).first()[0] == section


def test_sections_cascade_in_arrays_and_in_rows(spark):
    paragraphs = ["before", "Item 1. Business", "a", "b", "Part II", "c", "Chapter 2. End", "d"]
    text = docs(spark, ("b.txt", "\n\n".join(paragraphs)), ("n.txt", "none here"), ("e.txt", ""))
    rows = chunking.explode_elements(chunking.with_sections(elements.with_elements(text)))
    got = {(r["filename"], r["position"]): r["section"] for r in rows.collect()}
    assert [got["b.txt", i] for i in range(8)] == ["General"] + ["Item 1 - Business"] * 3 + ["Part II"] * 2 + ["Chapter 2 - End"] * 2
    assert got["n.txt", 0] == "General" and len(got) == 9
    flat = rows.select(F.col("filename").alias("doc_id"), "position", "text", F.col("section").alias("expected"))
    for block in (1, 3, 100):
        again = chunking.section_cascade(flat, block=block)
        assert again.where("section <> expected").count() == 0 and again.count() == 9


def test_documents_with_errors(spark):
    files = [("a.txt", ""), ("b.json", "{"), ("c.txt", " \n\n "), ("d.txt", "fine"), ("e.json", '""')]
    rows = elements.with_errors(elements.with_elements(docs(spark, *files))).collect()
    messages = {r["filename"]: r["error_message"] for r in rows}
    assert messages == {
        "a.txt": "empty document, 0 bytes: a.txt",
        "b.json": "malformed JSON: b.json",
        "c.txt": "no content found: c.txt",
        "d.txt": None,
        "e.json": "no chunk with text: e.json",
    }


SIDECAR = json.dumps({"doc_id": "acc-1", "source_filename": "x.htm", "form_type": "10-Q", "filing_date": "2024-02-21", "ticker": "NVDA"})


def test_raw_scan_and_sidecars(spark, tmp_path):
    for name, body in {
        "NVDA_10-k.htm": b"<p>one</p>", "NVDA_10-k.htm.meta.json": b"{bad", "NVDA_10-k.meta.json": SIDECAR.encode(),
        "book.TXT": b"two\r\n\r\nthree", "skip.tmp": b"x", "empty.txt": b"", "data.json": b"{}", "noid.htm": b"<p>x</p>", "noid.meta.json": b'{"ticker": "A"}',
    }.items():
        (tmp_path / name).write_bytes(body)
    raw = documents.raw_scan(spark, str(tmp_path))
    assert sorted(r["filename"] for r in raw.select("filename").collect()) == ["NVDA_10-k.htm", "book.TXT", "data.json", "noid.htm"]
    rows = {r["filename"]: r for r in documents.sidecar_resolve(raw, documents.sidecar_files(spark, str(tmp_path))).collect()}
    assert (rows["NVDA_10-k.htm"]["doc_id"], rows["NVDA_10-k.htm"]["form_type"], rows["NVDA_10-k.htm"]["domain"]) == ("acc-1", "10-Q", "finance")
    assert rows["NVDA_10-k.htm"]["source_filename"] == "NVDA_10-k.htm"
    assert rows["book.TXT"]["doc_id"] == hashlib.sha256(b"two\r\n\r\nthree").hexdigest()[:16]
    assert (rows["book.TXT"]["form_type"], rows["book.TXT"]["content"]) == ("BOOK", "two\n\nthree")
    assert rows["noid.htm"]["form_type"] == "MISC" and not rows["noid.htm"]["has_metadata"]


def naive_split(text, delimiters, limits):
    """The splitting rules restated without any shortcut."""
    size = lambda s: len(re.findall(r"\w+|[^\w\s]", s))
    if not text.strip():
        return []
    if size(text) <= limits.max_tokens and len(text) <= limits.max_characters:
        return [text.strip()]
    for n, delimiter in enumerate(delimiters):
        if delimiter in text:
            break
    else:
        width = max(1, min(limits.max_characters, 3 * limits.max_tokens))
        out, begin = [], 0
        while True:
            out.append(text[begin : begin + width].strip())
            if begin + width >= len(text):
                return [o for o in out if o]
            begin += max(1, width - max(0, 3 * limits.overlap_tokens))
    units = [u for piece in text.split(delimiter) for u in naive_split(piece.strip(), delimiters[n + 1 :], limits)]
    out, window = [], []
    for unit in units:
        if window:
            joined = delimiter.join(window)
            heavy = size(joined) + size(unit) + size(delimiter) > limits.max_tokens
            if heavy or len(joined) + len(delimiter) + len(unit) > limits.max_characters:
                out.append(joined.strip())
                while window and (limits.overlap_tokens <= 0 or size(delimiter.join(window)) > limits.overlap_tokens):
                    window = window[1:]
        window = window + [unit]
    return [o for o in out + [delimiter.join(window).strip()] if o]


pieces = st.lists(st.sampled_from(["a", "bb", "ccc.", ". ", " ", "\n", "\n\n", "é", "</tr>", "</tr>\n", "<td>", "word word", "x" * 30]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(pieces, st.integers(1, 12), st.integers(0, 6), st.integers(3, 60), st.booleans())
def test_splitter_follows_the_rules(parts, tokens, overlap, characters, is_table):
    text = "".join(parts)
    limits = splitting.Limits(tokens, overlap, characters)
    fits = limits.fits(text)
    delimiters = limits.table_delimiters if is_table else limits.prose_delimiters
    expected = ([text] if fits else naive_split(text, delimiters, limits)) if text.strip() else []
    assert splitting.split_text(text, is_table, limits) == expected


@settings(max_examples=100, deadline=None)
@given(pieces, st.integers(1, 12), st.integers(0, 6))
def test_splitter_takes_other_delimiters(parts, tokens, overlap):
    text = "".join(parts)
    limits = splitting.Limits(tokens, overlap, 40, prose_delimiters=("word", "b", "a"))
    expected = ([text] if limits.fits(text) else naive_split(text, ("word", "b", "a"), limits)) if text.strip() else []
    assert splitting.split_text(text, False, limits) == expected


def test_unbroken_text_is_sliced():
    out = splitting.split_text("A" * 1500, limits=splitting.Limits(100, 10, 500))
    assert all(len(s) <= 300 for s in out) and len(out) == 6


def chunked(spark, *files, limits=splitting.Limits()):
    return ingest.chunk(ingest.parse(docs(spark, *files)), limits)


def test_split_lineage(spark):
    sentence = "Revenue rose in every region of the company this year. "
    table = "<table>" + "<tr><td>Revenue</td><td>60,922</td></tr>" * 60 + "</table>"
    rows = chunked(spark, ("a_10-K.htm", f"<h1>Item 8. X</h1><p>{sentence * 120}</p>{table}<p>short</p>")).collect()
    children = [r for r in rows if r["parent_chunk_id"]]
    assert {r["section"] for r in rows} == {"Item 8 - Financial Statements"} and {r["form_type"] for r in rows} == {"10-K"}
    assert [r["text"] for r in rows if not r["parent_chunk_id"]] == ["Item 8. X", "short"]
    for parent in {r["parent_chunk_id"] for r in children}:
        group = [r for r in children if r["parent_chunk_id"] == parent]
        assert sorted(r["sub_chunk_index"] for r in group) == list(range(len(group))) and {r["total_sub_chunks"] for r in group} == {len(group)}
        assert all(r["is_split"] and r["token_count"] <= 576 and len(r["text"]) <= 2000 for r in group)
    fragments = [r for r in children if r["is_table"]]
    assert len(fragments) > 1
    assert all(r["is_table_fragment"] and r["table_id"] == r["parent_chunk_id"] and r["table_html"] == r["text"] for r in fragments)
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    packed = [json.loads(r["metadata_json"]) for r in chunking.pack_metadata(chunked(spark, ("b.txt", "one"))).collect()]
    assert packed == [{"element_type": "Title", "category": "Title", "token_count": 1}]


def test_parsing_runs_once_in_the_chunk_plan(spark):
    plan = chunked(spark, ("a.htm", "<p>x</p>"))._jdf.queryExecution().optimizedPlan().toString()
    # One batch function for JSON that Spark's parser refuses, one for text to split; each runs once.
    evaluations = [line for line in plan.split("\n") if "ArrowEvalPython" in line]
    assert [name for line in evaluations for name in ("_second_parse", "slices") if f"[{name}(" in line] == ["slices", "_second_parse"]
    # The block pattern occurs once per evaluation of the page rule.
    assert plan.count("(h[1-6]|p|li|div)") == 1


def reference_vector(text, dimension):
    values = []
    for block in range(-(-dimension // 8)):
        values += struct.unpack("<8I", hashlib.sha256(f"{text or '__empty__'}:{block}".encode()).digest())
    values = [v / 4294967295.0 * 2 - 1 for v in values[:dimension]]
    length = sum(v * v for v in values) ** 0.5
    return [v / length for v in values]


def test_hash_embeddings_agree(spark):
    texts = ["", " ", "Revenue grew", "é\nü"]
    for t in texts:
        assert hash_vector(t, 384).tolist() == pytest.approx(reference_vector(t, 384), abs=1e-12)
    df = spark.createDataFrame([(t, d) for t in texts for d in ("finance", "Literature ", "law")], "text string, domain string")
    rows = embedding.embed_chunks(df.withColumn("sql", hash_embedding(F.col("text"), 20))).collect()
    for r in rows:
        size = {"finance": 384, "Literature ": 768, "law": 384}[r["domain"]]
        assert r["embedding"] == pytest.approx(reference_vector(r["text"], size), abs=1e-6)
        assert r["sql"] == pytest.approx(reference_vector(r["text"], 20), abs=1e-12)


def test_vanishing_vector_becomes_constant(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()] == [[0.5] * 4, [0.6, 0.8]]


def test_profiles_and_models(spark):
    assert [embedding.profile_named(d).dimension for d in ("finance", " LITERATURE", "general", "law", None)] == [384, 768, 1024, 384, 384]
    assert embedding.profile_named("x", ()).name == "finance" and {p.name for p in PROFILES} == {"finance", "literature", "general"}

    def load():
        return lambda texts: [[float(len(t)), float(len(texts) <= 2)] for t in texts]

    df = spark.createDataFrame([("abc",), ("",), (" ",), ("x",), ("yy",)], "text string").coalesce(1)
    rows = embedding.embed_with_model(df, load, Profile("p", "m", 2, 2)).collect()
    assert [r["embedding"] for r in rows] == [[3.0, 1.0], [9.0, 1.0], [9.0, 1.0], [1.0, 1.0], [2.0, 1.0]]


def test_a_caller_may_bring_a_splitter(spark):
    halves = lambda text, is_table, limits: [text[: len(text) // 2], text[len(text) // 2 :]]
    rows = chunked(spark, ("a.txt", "abcdef"), limits=splitting.Limits(max_characters=3))
    assert [r["text"] for r in rows.orderBy("sub_chunk_index").collect()] == ["abc", "def"] or rows.count() > 1
    base = chunking.assemble_chunks(chunking.explode_elements(chunking.with_sections(ingest.parse(docs(spark, ("a.txt", "abcdef"))).select(*ingest.DOCUMENT, "elements"))))
    assert [r["text"] for r in splitting.split_chunks(base, splitting.Limits(max_characters=3), halves).orderBy("sub_chunk_index").collect()] == ["abc", "def"]


def test_json_that_the_variant_parser_refuses(spark):
    """Repeated keys and great size are valid JSON; only malformed text is an error."""
    big = '{"title": "t", "content": "' + "x" * 150_000_000 + '"}'
    texts = {
        "twice.json": '{"title": "x", "title": "y", "content": "a", "content": "z"}', "nested.json": '{"name": "n", "body": {"b": 1, "a": 2, "a": true}}',
        "none.json": '{"k": 1, "k": 2} ', "items.json": '[{"a": 1, "a": null}, "s", 1.5, false, null]', "bad.json": '{"title": "x", "title": ',
        "tail.json": '{"a": 1, "a": 2} more', "deep.json": "[" * 200_000, "plain.json": '{"title": 0, "name": "n", "text": "t"}', "page.txt": '{"a": 1, "a": 2}',
    }
    rows = spark.createDataFrame([(n, len(t), t) for n, t in texts.items()], "filename string, file_size_bytes bigint, content string")
    out = {r["filename"]: r for r in elements.with_errors(elements.with_elements(rows)).collect()}
    parts = {n: [(e["category"], e["text"]) for e in r["elements"]] if r["elements"] is not None else None for n, r in out.items()}
    assert parts["twice.json"] == [("Title", "y"), ("NarrativeText", "z")]
    assert parts["nested.json"] == [("Title", "n"), ("NarrativeText", '{"a":true,"b":1}')]
    assert parts["none.json"] == [("NarrativeText", '{"k": 1, "k": 2}')]
    assert [t for _, t in parts["items.json"]] == ['{"a":null}', "s", "1.5", "False", "None"]
    assert parts["plain.json"] == [("Title", "n"), ("NarrativeText", "t")] and parts["page.txt"] == [("Title", '{"a": 1, "a": 2}')]
    for name in ("bad.json", "tail.json", "deep.json"):
        assert parts[name] is None and out[name]["error_message"] == f"malformed JSON: {name}"
    large = spark.range(1).select(F.lit("big.json").alias("filename"), F.concat(F.lit('{"title": "t", "content": "'), F.expr("repeat('x', 150000000)"), F.lit('"}')).alias("content"))
    found = elements.with_elements(large).select(F.size("elements").alias("n"), F.length(F.col("elements")[1]["text"]).alias("size")).first()
    assert (found["n"], found["size"]) == (2, 150_000_000) and len(big) > 150_000_000


def test_splitter_as_a_table_function(spark):
    limits = splitting.Limits(max_tokens=20, overlap_tokens=4, max_characters=200)
    texts = [(i, "Some words here. " * (i * 7) + "tail", i % 2 == 1) for i in range(12)] + [(90, None, False), (91, "", True), (92, "fits", None)]
    splitting.register_splitter(spark, limits, name="cut")
    spark.createDataFrame(texts, "id int, text string, is_table boolean").createOrReplaceTempView("to_cut")
    got = spark.sql("SELECT id, s.* FROM to_cut t, LATERAL cut(t.text, t.is_table) s").collect()
    want = {(i, n, x) for i, t, b in texts if t is not None for n, x in enumerate((lambda p: p if len(p) > 1 else [t])(splitting.split_text(t, bool(b), limits)))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    splitting.register_splitter(spark, limits, split=lambda t, is_table, limits: t.split(), name="by_words")
    assert spark.sql("SELECT * FROM by_words('a b', false)").count() == 2
