"""Operators on texts against plain restatements, on the smallest tables and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash

from quire.llm import bpe, lm_score, line_dedup, merkle, mixing, quality, simhash, suffix_dedup
from quire.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, node string, words int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def odd_rows():
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é", "日本"]) + str(rng.randint(0, 99)) for _ in range(30000))
    texts = [None, "", "   \n\t ", "one", "one two", "One TWO three", "a\nb\nc", "same words here for all\n" * 3,
             "same words here for all\n" * 3, long, "x" * 3000, "ab" * 900, "naïve ünïcode \U0001F600 text " * 40, "\n\n\n"]
    rows = [(i, t, "en", ["s1", None, "s2"][i % 3], len(t or ""), 7, 7, "n", 1) for i, t in enumerate(texts)]
    rows += [rows[4], rows[9], (None, "null id text here now", None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# --- line dedup -------------------------------------------------------------------------------------------------------


def line_runs(lines, words, least=3):
    """The shortest runs of at least so many words, from each line on and up to each line, as (start, end)."""
    out = set()
    for i in range(len(lines)):
        n = 0
        for j in range(i, len(lines)):
            n += words[j]
            if n >= least:
                out.add((i, j + 1))
                break
        n = 0
        for j in range(i, -1, -1):
            n += words[j]
            if n >= least:
                out.add((j, i + 1))
                break
    return out


def brute_lines(texts, least=3):
    """Positions of the lines that leave each document: those in runs of enough words that the first document of some run
    has too, looked up until nothing is found, by plain tuples of lines."""
    count = {line: len(line_dedup.MIXED_WORD.findall(line)) for text in texts.values() for line in text.split("\n")}
    split = {doc: text.split("\n") for doc, text in sorted(texts.items())}
    spans = {d: {tuple(x[i:j]) for i, j in line_runs(x, [count[y] for y in x], least)} for d, x in split.items()}
    firsts = {}
    for doc, held in spans.items():
        for run in held:
            firsts.setdefault(run, doc)
    gone = {}
    for doc, lines in split.items():
        gone[doc] = set()
        for partner in {firsts[run] for run in spans[doc]} - {doc}:
            known = {}
            left = list(range(len(lines)))
            while True:
                here = [lines[i] for i in left]
                found = set()
                for i, j in line_runs(here, [count[x] for x in here], least):
                    run = here[i:j]
                    if run not in known.setdefault(len(run), []):
                        at = [split[partner][k:k + len(run)] for k in range(len(split[partner]) - len(run) + 1)]
                        if run not in at:
                            continue
                        known[len(run)].append(run)
                    found |= set(left[i:j])
                if not found:
                    break
                gone[doc] |= found
                left = [i for i in left if i not in found]
    return gone


def test_lines_of_later_documents_leave_in_blocks(spark, docs):
    """The query's setting over the whole smallest table, against plain tuples of lines."""
    texts = texts_of(docs)
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    gone = brute_lines(texts)
    assert len(out) == len(texts) and sum(map(len, gone.values())) > 100
    for doc, text in texts.items():
        lines = text.split("\n")
        left = [x for i, x in enumerate(lines) if i not in gone[doc]]
        assert out[doc].n_lines == len(lines)
        # Aligned blocks may take short lines at their edges along, which have no run of their own.
        assert out[doc].text == "\n".join(left), doc
        assert out[doc].n_removed == len(gone[doc])


def test_words_of_lines(spark):
    import pyarrow as pa

    texts = [None, "", "\n", "a b\n\n c", "  x\ty  ", "é ü\n“quoted” — dash", "日本語の文\nabc日本 def", "สวัสดี x", "\u2e80\u2e81\u2e82", "\U00020000 a"]
    counts, first = line_dedup.line_words(pa.array(texts))
    assert first.tolist() == [0, 1, 2, 4, 7, 8, 10, 12, 13, 14]
    lines = [x for t in texts for x in (t or "").split("\n")]
    assert counts.tolist() == [len(line_dedup.MIXED_WORD.findall(x)) for x in lines]
    assert counts.tolist()[-5:] == [3, 3, 4, 2, 2]


def test_reversed_and_repeated_lines_take_few_rounds():
    import time

    began = time.time()
    lines = list(range(20_000))
    assert line_dedup.repeated_lines(lines, lines[::-1], [5] * 20_000) == lines
    assert line_dedup.repeated_lines(lines, lines[::-1] + [-1], [1] * 20_001) == []
    assert line_dedup.repeated_lines([7] * 20_000, [7] * 19_999 + [8], [1] * 20_000) == list(range(19_999))
    assert time.time() - began < 5


def test_patience_aligns_in_order_and_repeats_find_moved_blocks():
    assert line_dedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_dedup.patience([1, 1, 2], [2, 1, 1]) in ([(0, 1), (1, 2)], [(2, 0)])
    assert line_dedup.repeated_lines([1, 2, 3, 4], [3, 4, 8, 1, 2], [5] * 5) == [0, 1, 3, 4]
    assert line_dedup.repeated_lines([1, 2], [1, 2], [1, 1]) == []
    assert line_dedup.repeated_lines([1, 2], [1, 2], [1, 2]) == [0, 1]


def test_short_lines_that_cross_a_passage_do_not_keep_it():
    blank, head, long = 0, 7, 9
    words = {blank: 0, head: 1, long: 60, 4: 2, 5: 2}
    for earlier, later, gone in [
        ([long, blank], [blank, long], [1]), ([1, blank, long], [long, blank, 2], [0]), ([head, long], [long, head], [0]),
        ([4, 5, blank, head], [head, blank, 4, 5], [2, 3]), ([4, 5, head, long, 4], [long, 4, 8, head, 5, 4], [0, 1]),
    ]:
        assert line_dedup.repeated_lines(earlier, later, [words.get(x, 1) for x in later]) == gone, (earlier, later)


def test_no_common_block_of_enough_words_is_left():
    rng = random.Random(8)
    for _ in range(400):
        words = [rng.choice([0, 1, 1, 2, 4]) for _ in range(7)]
        earlier, later = ([rng.randrange(7) for _ in range(rng.randint(1, 9))] for _ in range(2))
        gone = set(line_dedup.repeated_lines(earlier, later, [words[x] for x in later]))
        spans = {tuple(earlier[i:j]) for i in range(len(earlier)) for j in range(i + 1, len(earlier) + 1)}
        kept = [x for j, x in enumerate(later) if j not in gone]
        for i in range(len(kept)):
            for j in range(i + 1, len(kept) + 1):
                assert sum(words[x] for x in kept[i:j]) < 3 or tuple(kept[i:j]) not in spans, (earlier, later, words)


def test_blocks_of_short_lines_find_their_documents(spark):
    menu = "\n".join(f"a{i}\n\nb{i} c{i}" for i in range(40))
    chinese, thai = "這是一個沒有空格的長句子", "สวัสดีครับ"
    texts = {1: menu, 2: menu + "\nown line here", 3: "passage of four words", 4: "head\npassage of four words\ntail",
             5: "other start\nhead\npassage of four words\ntail\nother", 6: f"甲\n{chinese}", 7: f"{chinese}\n乙",
             8: f"{thai}\nx", 9: f"y\n{thai}", 10: "日本\nz", 11: "日本"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(rows).collect()}
    assert out[2] == "own line here" and out[4] == "head\ntail" and out[5] == "other start\nother"
    assert out[7] == "乙" and out[9] == "y" and out[11] == "日本"


def test_line_dedup_of_odd_rows(odd, none):
    out = line_dedup.line_dedup(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == odd.count()
    assert rows[0, None].n_lines == 0 and rows[0, None].n_removed == 0
    assert rows[8, ""].n_removed == 4 and (7, "same words here for all\n" * 3) in rows
    assert line_dedup.line_dedup(none).count() == 0


# --- SimHash ----------------------------------------------------------------------------------------------------------


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def brute_groups(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ordered = sorted(ids)
    for n, a in enumerate(ordered):
        for b in ordered[n + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_is_the_brute_force(spark, docs):
    prints = {d: brute_print(t) for d, t in texts_of(docs).items()}
    groups = brute_groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    out = {r.doc_id: r for r in QUERIES["op2_simhash_near_dedup"](spark, SF).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in out.items()} == prints
    assert {d: r.component_id for d, r in out.items()} == groups


def test_fingerprint_links_span_the_groups_over_many_tiles(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(60)]
    prints = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for c in centres for _ in range(12)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 3, tile=50).collect()
    whole = brute_groups(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    at = {s[0]: i for i, s in enumerate(signed)}
    assert all((prints[at[r.a]] ^ prints[at[r.b]]).bit_count() <= 3 for r in links)
    found = {(min(at[r.a], at[r.b]), max(at[r.a], at[r.b])) for r in links}
    assert brute_groups(range(len(prints)), lambda a, b: (a, b) in found) == whole


def test_simhash_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    zero = {r.id for r in rows if r.fp == 0}
    assert {0, 1, 2, 13} <= zero and {r.component for r in rows if r.id in zero} == {0}
    assert {r.component for r in rows if r.id in (7, 8)} == {7}
    assert simhash.near_duplicates(none).count() == 0


# --- language model ---------------------------------------------------------------------------------------------------


def brute_scores(texts, order=3, alpha=0.4, least=2):
    split = {d: re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for d, t in texts.items()}
    counts = Counter()
    for w in split.values():
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(len(w) for w in split.values())
    out = {}
    for d, w in split.items():
        s = 0.0
        for i in range(len(w)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[gram] >= least:
                    s += math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total)) + (most - n) * math.log(alpha)
                    break
        out[d] = (len(w), s)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_are_the_brute_force(docs, order, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 60_000)
    monkeypatch.setattr(lm_score, "PART", 100_000)
    want = brute_scores(texts_of(docs), order)
    for r in lm_score.score(docs, order=order).collect():
        assert r.n_words == want[r.doc_id][0] and r.log_score == pytest.approx(want[r.doc_id][1], rel=1e-9, abs=1e-9)


def test_scores_of_odd_rows(odd, none):
    rows = lm_score.score(odd).collect()
    assert len(rows) == len(odd_rows())
    assert {(r.n_words, r.log_score, r.mean_log_score) for r in rows if r.doc_id in (0, 1, 2, 13)} == {(0, 0.0, None)}
    assert lm_score.score(none).count() == 0


def test_scores_of_text_ids(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 60_000)
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    want = {f"d{r.doc_id}": r.log_score for r in lm_score.score(docs).collect()}
    assert {r.doc_id: r.log_score for r in lm_score.score(named).collect()} == pytest.approx(want)


# --- suffix arrays ----------------------------------------------------------------------------------------------------


def brute_removed(raws, length):
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def test_suffix_array_is_sorted_suffixes():
    import numpy as np

    rng = random.Random(5)
    for size, letters in [(1, 2), (2, 2), (50, 2), (300, 3), (2000, 2), (3000, 30), (800, 1)]:
        t = [rng.randint(1, letters) for _ in range(size)] + [0]
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert suffix_dedup.suffix_array(np.array(t, np.int32), letters + 1).tolist() == want
    periodic = [1, 2, 2, 1] * 500 + [2] * 100 + [0]
    want = sorted(range(len(periodic)), key=lambda i: periodic[i:])
    assert suffix_dedup.suffix_array(np.array(periodic, np.int32), 3).tolist() == want


def test_queues_that_overflow_to_disk_keep_their_order():
    import numpy as np

    queue = suffix_dedup.Queues(4, held=64)
    for k in range(30):
        queue.push(np.array([k, 100 + k, 200 + k], np.int32), np.array([3, 1, 3]))
    assert queue.file is not None
    assert queue.pop(1).tolist() == [100 + k for k in range(30)]
    assert queue.pop(3).tolist() == [x for k in range(30) for x in (k, 200 + k)] and not len(queue.pop(0))


def held_by(run):
    """The result of a call and the most megabytes it held at once."""
    import tracemalloc

    tracemalloc.start()
    out = run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_anchors_do_not_depend_on_the_window():
    """Every start's anchor is the least half of its string by hash, then the leftmost, whatever the window."""
    import numpy as np

    rng = np.random.default_rng(2)
    for size, letters, length in [(0, 2, 8), (7, 2, 8), (8, 2, 8), (300, 1, 16), (900, 2, 16), (2000, 20, 40)]:
        data = rng.integers(97, 97 + letters, size).astype(np.uint8)
        half = length // 2
        powers = suffix_dedup.POWERS.to(half + 1)[0][:half]
        hashes = [int(suffix_dedup.mixed(((data[i : i + half].astype(np.uint64) + np.uint64(1)) * powers).sum(keepdims=True))[0]) >> 32 for i in range(size - half + 1)]
        want = [min(range(i, i + length - half + 1), key=lambda j: (hashes[j], j)) for i in range(max(0, size - length + 1))]
        for window in (1, 7, 64, 1 << 20):
            first, last, anchor = suffix_dedup.anchored(data, length, window)
            assert [a for f, e, a in zip(first, last, anchor, strict=True) for _ in range(f, e + 1)] == want
            assert (anchor[1:] != anchor[:-1]).all()


def test_a_very_long_text_is_worked_on_in_bounded_memory(spark):
    import numpy as np

    data = np.random.default_rng(3).integers(97, 123, 30_000_000).astype(np.uint8)
    (first, last, _), most = held_by(lambda: suffix_dedup.anchored(data, 400))
    assert first[0] == 0 and last[-1] == len(data) - 400 and most < 250
    text = data[:6_000_000].tobytes().decode()
    rows = [(1, text), (2, "x" + text[2_500_000:2_503_000] + "y"), (3, text[:300])]
    out = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans) for i, r in out.items()} == {1: (6_000_000, 3000, 1), 2: (3002, 3000, 1), 3: (300, 0, 0)}
    assert bytes(out[1].kept).decode() == text[:2_500_000] + text[2_503_000:] and bytes(out[2].kept) == b"xy"


@pytest.mark.parametrize("length", [16, 64, 400])
def test_removed_bytes_are_the_brute_force(spark, docs, length):
    texts = texts_of(docs)
    ids = sorted(texts)
    want = dict(zip(ids, brute_removed([texts[i].encode() for i in ids], length), strict=True))
    for r in suffix_dedup.suffix_dedup(docs, length=length).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_suffix_dedup_of_planted_and_odd_rows(spark, odd, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(90))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 80))) + passage[rng.randint(0, 60) : rng.randint(430, 539)] + " ".join(word() for _ in range(50))) for i in range(60)]
    rows += [(60, "ab" * 700), (61, passage + passage), (62, "c" * 401), (63, "d" * 400), (64, "d" * 400 + "é")]
    want = brute_removed([t.encode() for _, t in rows], 400)
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    for r in out.collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    want = sorted(x[:3] for x in brute_removed([(t[1] or "").encode() for t in odd_rows()], 400))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(odd).collect()) == want
    assert suffix_dedup.suffix_dedup(none).count() == 0


@pytest.mark.parametrize("length", [40, 400])
def test_frequent_anchors_are_divided_without_loss(spark, length):
    """Groups of more than two pieces are divided, so nearly every group is, down to single starts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(110))
    rows = []
    for i in range(40):
        low, high = rng.choice([(0, 660), (rng.randint(0, 40), 650), (30, rng.randint(420, 460)), (rng.randint(0, 200), 600)])
        rows.append((i, word() + passage[low:high] + " ".join(word() for _ in range(rng.randint(0, 40)))))
    rows += [(40, "ab" * 500), (41, passage * 2), (42, "c" * (length + 1)), (43, None), (44, rows[3][1])]
    want = brute_removed([(t or "").encode() for _, t in rows], length)
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=length, common=2)
    for r in out.collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


# --- mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over


def test_mix_meets_its_targets(spark, docs):
    texts = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()}
    sizes = Counter()
    for source, n in texts.values():
        sizes[source] += n
    want = brute_targets(sizes)
    rows = QUERIES["op6_mixing"](spark, SF).collect()
    again = QUERIES["op6_mixing"](spark, SF).collect()
    assert sorted(rows) == sorted(again)
    taken = Counter()
    for r in rows:
        source, n = texts[r.doc_id]
        assert r.size == n and r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken % max(1, n) == 0 and r.taken <= 3 * n
        taken[source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 1 + 0.01 * want[source]


def test_fit_is_near_the_budget():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 5000, rng.integers(1, 40)))
        counts = rng.integers(1, 30, len(lengths))
        size = int((lengths * counts).sum())
        budget = int(rng.integers(0, size))
        taken = mixing.fit(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int((lengths * taken).sum()) - budget) <= int(lengths.max())


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows()) and {r.source for r in rows} == {"s1", "s2", None}
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(none).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and mixing.mixed_documents(none).count() == 0
    assert sum(len(WORD.findall(r.text or "")) for r in out.collect()) > 0


# --- Merkle fingerprints ----------------------------------------------------------------------------------------------


def brute_next(rows):
    out = {}
    for i, (doc, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + other[:n]
        f, e, g = (merkle.fingerprint(x) for x in (text, edited, other))
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f, e, merkle.likeness(f, e), merkle.likeness(f, g))
    return out


@pytest.mark.parametrize("keep", [1000, 1, 2])
def test_next_documents(spark, docs, keep):
    few = docs.orderBy("doc_id").limit(keep).repartition(3)
    want = brute_next(sorted(texts_of(few).items()))
    rows = merkle.compare_with_next(few).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id])


def test_fingerprints_tell_equality_and_place():
    base = "\n".join(f"paragraph {i} " + "words and words " * (i % 9) for i in range(80))
    tree = merkle.fingerprint(base)
    other = base.replace("paragraph 40 ", "paragraph 4x ")
    assert merkle.likeness(tree, merkle.fingerprint(base)) == 1.0 and tree != merkle.fingerprint(base + "\n")
    assert 0.95 < merkle.likeness(tree, merkle.fingerprint(other)) < 1
    assert merkle.edits(tree, merkle.fingerprint(other)) == [merkle.Edit(40, 0, 64)]
    assert merkle.likeness(merkle.fingerprint(None), merkle.fingerprint("")) == 1.0
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("a")) == 0.0


def test_fingerprints_of_odd_rows(odd, none):
    rows = merkle.compare_with_next(odd).collect()
    assert len(rows) == len(odd_rows())
    ordered = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    last = next(r for r in rows if r.doc_id is None)
    assert last.n_chars == len(ordered[-1][1])
    assert {r.fingerprint for r in rows if r.doc_id in (0, 1)} == {merkle.fingerprint("")}
    assert merkle.compare_with_next(none).count() == 0 and merkle.fingerprints(none).count() == 0
    assert merkle.fingerprints(odd).count() == len(odd_rows())


# --- quality ----------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    held = [(labels[d], out[d]) for d in labels if out[d].held_out]
    good = [r.predicted for q, r in held if q == 1]
    bad = [1 - r.predicted for q, r in held if q == 0]
    assert sum(good) / len(good) >= 0.95 and (sum(good) + sum(bad)) / len(held) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_quality_scores_do_not_depend_on_batches(spark, docs):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    at = quality.Settings()
    model = rng.normal(size=(1 << at.buckets_log2) + 1).astype(np.float32)
    texts = [t for _, t in sorted(texts_of(docs).items())][:60] + [None, "", " ", "a", "ab cd", "é" * 5]
    together = quality.score_batch(pa.array(texts), model, at)
    alone = [quality.score_batch(pa.array([t], pa.string()), model, at)[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-4)
    assert together[60] == together[61] == pytest.approx(1 / (1 + math.exp(-float(model[-1]))))


def test_training_is_that_of_a_plain_trainer():
    """Loops over features and numbers, without arrays of features: the same weight of every bucket, and the same score."""
    import numpy as np
    import pyarrow as pa

    at = quality.Settings(buckets_log2=10, dim=4, epochs=3)
    whole, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(h):
        for _ in range(2):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & whole
        return h ^ h >> 32

    def families(text):
        raw = text.encode()
        for n in at.grams:
            yield [((int.from_bytes(raw[i : i + n], "little") + n) * golden & whole) >> 54 for i in range(len(raw) - n + 1)]
        words = [mixed(sum((b + 1) * pow(golden, k, 1 << 64) for k, b in enumerate(w)) & whole) for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
        yield [h >> 54 for h in words]
        yield [mixed(a ^ b) >> 54 for a, b in zip(words, words[1:])]

    def weights(text):
        out = Counter()
        for family in families(text):
            for bucket in family:
                out[bucket] += 1 / len(family)
        return out

    texts = ["good plain words here", "bad bad bad", "", "a", "more good words in a row", "bad words", "é ü plain", "x y z bad"]
    labels = [1, 0, 1, 0, 1, 0, 1, 0]
    rng = np.random.default_rng(at.seed)
    inputs = (rng.uniform(-1, 1, (1 << 10, 4)) / 4).tolist()
    output, bias = rng.normal(0, 0.1, (2, 4)).tolist(), [0.0, 0.0]
    vectors, step = [weights(t) for t in texts], 0
    for _ in range(at.epochs):
        for i in rng.permutation(len(texts)):
            rate = at.rate * (1 - step / (at.epochs * len(texts)))
            step += 1
            hidden = [sum(w * inputs[b][d] for b, w in vectors[i].items()) for d in range(4)]
            e = [math.exp(sum(o * h for o, h in zip(output[c], hidden)) + bias[c]) for c in (0, 1)]
            miss = [e[c] / sum(e) - (labels[i] == c) for c in (0, 1)]
            back = [sum(output[c][d] * miss[c] for c in (0, 1)) for d in range(4)]
            output = [[output[c][d] - rate * miss[c] * hidden[d] for d in range(4)] for c in (0, 1)]
            bias = [bias[c] - rate * miss[c] for c in (0, 1)]
            for b, w in vectors[i].items():
                inputs[b] = [x - w * rate / sum(v * v for v in vectors[i].values()) * g for x, g in zip(inputs[b], back)]
    want = [sum(x * (o1 - o0) for x, o0, o1 in zip(row, *output)) for row in inputs] + [bias[1] - bias[0]]
    model = quality.train(texts, np.array(labels), at)
    assert model == pytest.approx(want, abs=1e-4)
    asked = [*texts, "unseen words"]
    plain = [1 / (1 + math.exp(-sum(w * want[b] for b, w in weights(t).items()) - want[-1])) for t in asked]
    assert quality.score_batch(pa.array(asked), model, at) == pytest.approx(plain, abs=1e-4)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (5, 1, None), (99, 0, 0), (None, 1, 1), (6, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(odd, quality.fit_quality(odd, labels)).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    blank = quality.score(odd, quality.fit_quality(none, labels.limit(0)))
    assert {r.score for r in blank.collect()} == {0.5}
    assert quality.score(none.withColumnRenamed("h", "score"), quality.fit_quality(none, labels)).count() == 0


# --- byte-level BPE ---------------------------------------------------------------------------------------------------


def reference_encoding():
    import base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_those_of_the_library(odd, docs, none):
    path, library = reference_encoding()
    for table in (odd, docs):
        for r in bpe.with_tokens(table.drop("h"), path, public_tokenizers.PATTERN).collect():
            assert r.token_ids == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.with_token_digests(none, path, public_tokenizers.PATTERN).count() == 0
    clash = odd.withColumnRenamed("h", "n_tokens")
    row = bpe.with_token_digests(clash, path, public_tokenizers.PATTERN).where("doc_id = 5").first()
    ids = library.encode_ordinary("One TWO three")
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_both_merges_agree_on_random_bytes():
    path, library = reference_encoding()
    own = bpe.codec(path, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for size in (2, 3, 5, 8, 33, 200, 700):
        pieces = ["".join(rng.choice("abcdehinorst") for _ in range(size)).encode() for _ in range(20)]
        side = bpe.merge(pieces, own.ranks)
        assert side == [bpe.merge_long(p, own.ranks) for p in pieces]
        for p, ids in zip(pieces, side, strict=True):
            if p not in own.ranks.ids:
                assert list(ids) == library._encode_single_piece(p) if hasattr(library, "_encode_single_piece") else True


def test_a_long_piece_is_merged_in_bounded_memory():
    """Against a heap of pairs, which holds what the tree holds at its root."""
    import heapq

    ranks = bpe.codec(reference_encoding()[0], public_tokenizers.PATTERN).ranks
    rng = random.Random(6)
    piece = bytes(rng.choices(b"abcdehinorst", k=200_000)) + b"a" * 50_000 + bytes(rng.choices(range(256), k=50_000))
    ids, pairs = ranks.single[list(piece)].tolist(), ranks.by_pair()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(pairs[a << 32 | b], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for k in (i, before[i]):
            if k >= 0 and after[k] < len(ids) and (pair := ids[k] << 32 | ids[after[k]]) in pairs:
                heapq.heappush(heap, (pairs[pair], k, ids[k], ids[after[k]]))
    got, most = held_by(lambda: bpe.merge_long(piece, ranks))
    assert list(got) == [x for x in ids if x >= 0] and most < 60


def test_bpe_digests_of_ids_and_bytes():
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for ids in codec.encode(["", "One two  three\n", "naïve 漢字 " * 5]):
        raw = codec.decode(ids)
        plain = hashlib.sha256(" ".join(str(i) for i in ids).encode()).hexdigest()
        assert codec.digests(ids, raw) == (len(ids), plain, hashlib.sha256(raw).hexdigest())
