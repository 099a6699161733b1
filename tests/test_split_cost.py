"""What parsing and splitting cost a row: no scan of the rest of a page for each end of a tag, no Python call for each text."""

import re
import time

from pyspark.sql import functions as F

from catalog import documents
from quire.operators import elements, splitting

FORMER = r"(?i)<(h[1-6]|p|li|div)[\s\S]*?>[\s\S]*?</\1>"
FORMER_TABLE = r"(?i)<table[\s\S]*?</table>"
PAGES = [
    "", "no markup", "<p>a</p><P class='x>y'>b\nc</p>", "<link rel=a><li>one</LI><li>two", "<p <p>x</p>", "<div\n id=1\n>a<div>b</div></div>", "<h1>t</H1><h2>u</h1>v</h2>",
    "<header>x</header><h7>y</h7><p", "<p>", "<pre>z</pre></p>", "a<table><tr>\n</table>b<TABLE x></TABLE><table>", "<p q>r\u0085s</p>",
]


def test_blocks_and_tables_are_those_of_the_former_patterns(spark):
    rows = spark.createDataFrame([(p,) for p in PAGES], "page string")
    pairs = ((elements.BLOCK, FORMER), (elements.TABLE, FORMER_TABLE))
    for now, former in pairs:
        found = rows.select("page", *[F.regexp_extract_all("page", F.lit(p), F.lit(0)).alias(n) for n, p in (("now", now), ("former", former))]).collect()
        assert all(r["now"] == r["former"] for r in found)
        assert sum(len(r["now"]) for r in found) > 1


def test_unclosed_blocks_do_not_rescan_the_page(spark):
    """The former pattern took the square of the blocks times the page: minutes for this one."""
    page = "<link href=a> some words " * 4000 + "<p>end</p>"
    rows = spark.createDataFrame([("page.html", page)], "filename string, content string")
    started = time.time()
    found = elements.with_elements(rows).first()["elements"]
    assert time.time() - started < 30
    assert [e["text"] for e in found] == ["end"]


def test_the_table_function_is_no_python_call_for_each_row(spark):
    splitting.register_splitter(spark, splitting.Limits(), name="cut_cheaply")
    spark.createDataFrame([(1, "a b", False), (2, None, None)], "id int, text string, is_table boolean").createOrReplaceTempView("cheap")
    out = spark.sql("SELECT id, s.* FROM cheap c, LATERAL cut_cheaply(c.text, c.is_table) s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [" in plan and "UDTF" not in plan and "Join" not in plan
    assert [tuple(r) for r in out.collect()] == [(1, 0, "a b")]


def test_words_of_a_slice_are_distinct_before_they_travel(spark, tmp_path):
    tables = {
        "documents": [(1, "one two one. " * 400 + "three", "en", "s", 1), (2, None, "en", "s", 0)],
        "pages": [(1, "u", "<p>x x y</p>")],
        "conversations": [(1, 0, "user", "hi")],
    }
    schemas = {
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
        "pages": "page_id bigint, url string, html string",
        "conversations": "conv_id bigint, turn int, role string, text string",
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, schemas[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    out = documents.split_bounds(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"collect_list\(array_distinct\(regexp_extract_all", plan)
    got = {r["doc_id"]: r["words"] for r in out.collect()}
    assert got["whole-1"] == 3 and got["page_1.htm"] == 2
