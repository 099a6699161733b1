"""Url filters, embeddings, components and the pipeline."""

import base64
import itertools
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quire.llm import embedding_dedup, queries, url_filter
from quire.llm.graph import components
from tests.llm.test_text_operators import brute_lines, brute_print

SF = "/root/testdata/sf0.001"


def test_url_verdicts_are_those_of_the_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
        want = sorted(con.sql(queries.ORACLES["op3_url_filters"]).fetchall(), key=str)
        got = sorted((tuple(r) for r in queries.QUERIES["op3_url_filters"](spark, sf).collect()), key=str)
        assert got == want


def test_url_filters_of_odd_rows(spark):
    urls = [None, "", "example.com/en/1", "HTTP://Example.COM/en/1", "http://example.com", "http://example.com/en", "x://www.example.com/en/?q#f",
            "x://a.www.example.com/en/2", "x://notexample.com/en/1", "x://com/", "x://net/es/1", "x://a.net/fr/", "x://a.org/net/es/",
            "x://a.org/#.net#/es/", "x://h.org?x=.net/es/", "x://spam-farm.org/", "x://a.com:80/en/", "x://a://b.com/", "x://net/es/" + "p" * 50000, "x://a.net\n/es/",
            "x://cheap-pills.org", "x://a.org/PILLS.cheap", "x://a.org/cheap--pills", "x://a.org/pills?x&cheap", "x://cheapest-pills.org",
            "x://a.org/pills-win-bonus", "x://free-bets.a.com/"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = [url_filter.host_rule(*r) for r in queries.HOST_RULES] + list(url_filter.UNWANTED)
    got = url_filter.judge(pages, rules)
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    want = sorted(con.sql(queries.ORACLES["op3_url_filters"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    verdicts = [r.verdict for r in sorted(got.collect(), key=lambda r: r.id)][-7:]
    assert verdicts == ["block", "block", "allow", "allow", "allow", "block", "allow"]
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    tied = [url_filter.pattern_rule("block", "b", ["com"]), url_filter.pattern_rule("deny", "a", ["com"])]
    assert url_filter.judge(pages.where("page_id = 7"), tied).first().verdict == "deny"


def test_rules_are_filed_under_their_rarest_token(spark):
    """Of two tokens the one fewer urls hold fetches the rule, so a frequent one costs no expression."""
    urls = [(i, f"x://a.org/free/page{i}") for i in range(30)] + [(30, "x://a.org/free-bets"), (31, "x://a.org/bets/free")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = [url_filter.word_rule("block", "free", "bets"), url_filter.word_rule("block", "free", "page7")]
    assert {r.id for r in url_filter.judge(pages, rules).where("verdict = 'block'").collect()} == {7, 30, 31}
    index = url_filter.rarest_tokens(pages.selectExpr("split(substring(url, 11), '[^a-z0-9]+') AS tokens"), rules)
    assert {(r.token, len(r.filed)) for r in index.collect()} == {("bets", 1), ("page7", 1)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(300, 380)] + [(7, 7), (None, 3), (400, 401), (401, 400)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert out == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(300, 380)]} | {400: 400, 401: 400}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_vectors(ids, vectors, least=0.95):
    v = np.array(vectors, np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= least
    np.fill_diagonal(near, False)
    part = np.array(ids)
    while True:
        new = np.minimum(part, np.where(near, part[None, :], 1 << 60).min(axis=1))
        if (new == part).all():
            return dict(zip(ids, zip(near.sum(axis=1).tolist(), part.tolist(), strict=True), strict=True))
        part = new


def test_vector_links_against_all_pairs(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = brute_vectors(table.vec_id.tolist(), np.vstack(table.embedding))
    got = {r.vec_id: r for r in queries.QUERIES["op10_embedding_near_dedup"](spark, sf).collect()}
    assert len(got) == len(want)
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize(("size", "dims"), [(400, 64), (1500, 64), (1500, 256)])
def test_recall_on_planted_pairs(spark, size, dims):
    """Pairs planted around the threshold, all rows against all: no link too many, and recall of those there are."""
    rng = np.random.default_rng(size + dims)
    base = rng.normal(size=(size, dims))
    base /= np.linalg.norm(base, axis=1)[:, None]
    turn = rng.normal(size=base.shape)
    turn -= (turn * base).sum(axis=1)[:, None] * base
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    cosine = rng.uniform(0.93, 0.99, size=size)[:, None]
    near = cosine * base + np.sqrt(1 - cosine**2) * turn
    vectors = np.concatenate([base, near, near[:20]])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    want = brute_vectors(range(len(vectors)), vectors)
    links = sum(n for n, _ in want.values())
    assert links > size  # pairs count at both ends
    got = {r.id: r for r in embedding_dedup.near_vectors(table).collect()}
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    recall = sum(r.n_links for r in got.values()) / links
    print(f"recall {recall:.4f} of {links // 2} links, {size} pairs, {dims} dimensions")
    assert recall >= 0.97


@pytest.mark.parametrize("block", [64, 1 << 15])
def test_many_near_copies_share_codes(spark, monkeypatch, block):
    """Tight groups of up to 300 vectors, in blocks of four and in blocks that hold a code whole; chains at the threshold."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(3, 16))
    groups = [centres[g] + rng.normal(size=(size, 16)) * spread for g, (size, spread) in enumerate([(300, 0.001), (60, 0.05), (40, 0.25)])]
    vectors = np.concatenate([*groups, groups[0][:30], rng.normal(size=(50, 16))])
    order = rng.permutation(len(vectors))
    rows = [(int(i), v.tolist()) for i, v in zip(order, vectors)]
    want = brute_vectors([i for i, _ in rows], vectors)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.id: r for r in embedding_dedup.near_vectors(table).collect()}
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    close = {int(i) for i in order[:360]} | {int(i) for i in order[400:430]}
    assert all((got[i].n_links, got[i].component) == want[i] for i in close)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_links_told_join_what_the_hits_join():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, y = rng.permutation(60)[:30].astype(np.int64), np.arange(60, 60 + int(rng.integers(1, 30)))
        hits = rng.random((len(x), len(y))) < rng.choice([0.02, 0.1, 0.6])
        a, b = embedding_dedup._told(x, y, hits)
        assert len(a) <= len(x) + len(y)

        def parts(links):
            part = {int(n): int(n) for n in [*x, *y]}
            while True:
                before = dict(part)
                for u, v in links:
                    part[u] = part[v] = min(part[u], part[v])
                if part == before:
                    return part

        i, j = np.nonzero(hits)
        assert parts(list(zip(a.tolist(), b.tolist()))) == parts(list(zip(x[i].tolist(), y[j].tolist())))


def test_few_rows_are_sorted_for_the_sample(spark):
    """The sample is the rows of least node, and tasks together send the driver little more than it, however many they are."""
    table = spark.range(0, 5000, 1, 40).selectExpr("xxhash64(id) AS node", "id")
    for sample in (1, 50, 1000, 5000, 9000):
        low = embedding_dedup._low(table, 5000, sample)
        assert low.count() <= min(5000, sample + 20 * sample**0.5)
        want, got = (rows.orderBy("node").limit(sample).collect() for rows in (table, low))
        assert got == want
    close = table.selectExpr("abs(node) AS node", "id")  # nodes that are not spread as hashes are
    want, got = (rows.orderBy("node").limit(50).collect() for rows in (close, embedding_dedup._low(close, 5000, 50)))
    assert got == want


def test_vectors_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    rows = [(i, base[i % 6].tolist(), "c") for i in range(30)]
    rows += [(30, (base[0] * 2).tolist(), "c"), (31, None, "c"), (32, [], "c"), (33, [0.0] * 16, "c"), (34, [float("nan")] * 16, None),
             (35, [float("inf")] + [1.0] * 15, "c"), (36, [None] + [1.0] * 15, "c"), (37, [1.0] * 5, "c"), (None, base[1].tolist(), "c"), (3, base[3].tolist(), "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    got = embedding_dedup.near_vectors(table).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert by[30].component == 0 and by[30].n_links == 5 and by[0].kept and not by[30].kept
    assert all(by[i].n_links == 0 and by[i].component == i and by[i].kept for i in range(31, 38))
    assert by[1].n_links == 5 and by[None].component == 1 and not by[None].kept
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0
    assert embedding_dedup.near_vectors(table.where("vec_id = 31")).count() == 1


def test_pipeline_keeps_columns_and_its_decisions(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.stored(stage(spark, tables[-1], sf), "stage"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tables[-1].columns == columns and tables[-1].dtypes == docs.dtypes
    start, good, lines, near, mixed, encoded = ([r.asDict() for r in t.collect()] for t in tables)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r["doc_id"] for r in good}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in left for d in clean) >= 0.97 * len(clean)
    assert sum(d not in left for d, q in labels.items() if q == 0) >= 0.8 * sum(q == 0 for q in labels.values())
    assert sorted(r["doc_id"] for r in lines) == sorted(left)
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    kept = {r["doc_id"] for r in near}
    assert kept < {r["doc_id"] for r in lines} and len(near) == len(kept)
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= kept and max(times.values()) <= 3
    assert len(encoded) == len(mixed) and all(r["round_trip"] for r in encoded)


def fingerprint_groups(rows):
    """Component of every row by all pairs of fingerprints, from (id, text) rows."""
    prints = [brute_print(text) for _, text in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            up[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(0, "T text of four"), (1, "other words altogether here"), (1, "T text of four"), (5, "U u u"), (5, "U u u"), (None, "A null id"),
             (None, "A null id"), (None, "shared with three"), (3, "shared with three"), (None, None), (2, ""), (None, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, table, SF).collect()]
    groups = {}
    for row, group in zip(rows, fingerprint_groups(rows), strict=True):
        groups.setdefault(group, []).append(row)
    assert len(kept) == len(groups)
    for own in groups.values():
        least = min((i is None, i or 0) for i, _ in own)
        assert len([k for k in kept if k in own and (k[0] is None, k[0] or 0) == least]) == 1
    assert kept.count((5, "U u u")) == 1 and (1, "T text of four") not in kept and (0, "T text of four") in kept
    assert kept.count((None, "A null id")) == 1 and (None, "shared with three") not in kept


def test_line_stage_is_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    gone = brute_lines(texts)
    out = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, SF).collect()}
    assert out == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in texts.items()}


def test_mixing_stage_takes_what_the_mix_says(spark):
    rows = [(i % 40, f"words of text {'x ' * (i % 7)}{i % 40}", ["a", "b", None][i % 3]) for i in range(400)] + [(900, "one two three", "b")] * 101
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {}
    for r in corpus_pipeline.mixing.mix(table).collect():
        want[r.row_hash] = want.get(r.row_hash, 0) + r.copies
    got = corpus_pipeline.mixing_stage(spark, table, SF)
    key = got.selectExpr("xxhash64(17, doc_id, text) AS k").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in key} == {k: n for k, n in want.items() if n}


def test_quality_and_encoding_stages_are_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r.doc_id for r in queries.QUERIES["op8_quality_classifier"](spark, SF).collect() if r.predicted}
    assert {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()} == scored
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in corpus_pipeline.encoding_stage(spark, docs, SF).collect():
        assert r.round_trip and list(r.token_ids) == plain.encode_ordinary(r.text or "")


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_of_clashing_names(spark, stage):
    names = ["token_ids", "round_trip", "decoded", "own_ids", "own_decoded", "key", "__key", "__n", "row", "row_key", "n_lines", "N_Removed",
             "quality_score", "fp", "component", "unnamed", "at", "rest", "each", "row_hash", "copies", "size", "h", "lines", "words", "gone", "label"]
    rows = [(i, f"Plain words of text {i}\nand more of them {i}", "en", "s", 30, *[f"{c}{i}" for c in names]) for i in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    table = spark.createDataFrame(rows, schema)
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, table, SF)
    last = stage == len(corpus_pipeline.STAGES) - 1
    kept = [c for c in table.columns if not (last and c in ("token_ids", "round_trip"))]
    assert out.columns == kept + ["token_ids", "round_trip"] * last
    for r in out.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in names if c in kept)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_of_odd_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, id string"
    rows = [(1, None, "en", None, None, 0.5, "a"), (2, "", None, "s", 0, None, "b"), (2, "", None, "s", 0, None, "b"),
            (None, "words of a null id", "en", "s", 4, 0.1, None), (4, "Some plain words\nand more of them", "en", "s", 30, 0.1, "c")]
    name, run = corpus_pipeline.STAGES[stage]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        out = run(spark, table, SF)
        assert out.columns[: len(table.columns)] == table.columns
        assert out.count() <= 3 * len(rows)
