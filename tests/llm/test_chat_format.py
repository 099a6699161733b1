"""Chat formatting: every conversation read back from the shared sequences equals its rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import chat_format
from quire.llm.queries import CONTROL_TEXT, QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string, path string, conv int, tokens int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(turns):
    """The contract's digests for one conversation's (role, text) turns; the template by plain replacement."""
    formatted = "".join(
        "### " + r.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "\\</turn>").replace(":", "\\:") + ": "
        + t.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "\\</turn>") + "</turn>\n" for r, t in turns
    )
    learnt = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(formatted))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_reads_back_every_conversation(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-7: [("user", CONTROL_TEXT), ("assistant", CONTROL_TEXT)]}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_chat_formatting"](spark, f"/root/testdata/{sf}").collect()}
    assert got == {c: brute(t) for c, t in want.items()}


def test_texts_and_roles_come_back():
    rng = random.Random(1)
    parts = ["\\", "#", "###", "</turn>", "<", "/turn>", ": ", "### Assistant: ", "a", "é", "\n", "\\</turn>\n### user: ", " ", "\U0001F600"]
    for _ in range(3000):
        turns = [tuple("".join(rng.choices(parts, k=rng.randrange(6))) for _ in "ab") for _ in range(rng.randrange(4))]
        formatted = "".join("".join(chat_format.turn_parts(r, t)) for r, t in turns)
        assert chat_format.turns_of(formatted) == turns
    for broken in ("### a: b", "x### a: b</turn>\n", "### a: b</turn>\n\n"):
        with pytest.raises(ValueError):
            chat_format.turns_of(broken)


def tree_rows():
    rng = random.Random(6)
    rows = []
    for conv in range(400):
        turns = ["Be brief."] if conv % 3 == 0 else []
        turns += [f"Say {'very ' * 9}{rng.randrange(2)} {rng.randrange(3)}" for _ in range(rng.randrange(1, 6))]
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * 3
        rows += [(conv, t, r, x) for t, (r, x) in enumerate(zip(roles, turns))]
    rows += [(500 + i, t, r, "Same.") for i in range(200) for t, r in enumerate(["user", "assistant"])]
    rows += [(800, None, "user", None), (800, 2, None, "b"), (800, 2, "assistant", "a"), (800, 2, "assistant", "a"), (801, 0, "x:\\#", CONTROL_TEXT)]
    rows += [(None, 1, "user", "alone"), (None, 1, "user", "alone"), (None, None, None, None), (900, 0, "assistant", "long " * 60000)]
    return rows


def expected(rows):
    left, out = {}, []
    for i, (conv, turn, role, text) in enumerate(rows):
        left.setdefault((conv, i if conv is None else 0), []).append((turn is not None, turn or 0, role or "", text or ""))
    for (conv, _), turns in left.items():
        out.append((conv, *brute([t[2:] for t in sorted(turns)])))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 500, 10**6])
def test_sequences_share_turns(spark, most):
    rows = tree_rows()
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    segments, convs = chat_format.formatted_conversations(frame, PATH, PATTERN, max_tokens=most)
    read = chat_format.read_back(segments, PATH, PATTERN)
    got = convs.join(read, "path_key").select("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    tokens = chat_format.tokenizer(PATH, PATTERN)
    by_sequence = {}
    for r in segments.orderBy("sequence", "start", F.size("tokens")).collect():
        by_sequence.setdefault(r.sequence, []).append(r)
    for own in by_sequence.values():
        whole, nodes = [], set()
        for r in own:
            assert r.start == len(whole)
            before = sum(s.end - s.start for s in r.ancestors)
            assert list(r.positions) == list(range(before, before + len(r.tokens)))
            assert all(0 <= a.start < a.end <= r.start for a in r.ancestors)
            seen = [t for s in r.ancestors for t in whole[s.start:s.end]]
            path = tuple(chat_format.turns_of(tokens.text(np.array(seen, np.int32))))
            for turn in chat_format.turns_of(tokens.text(np.array(r.tokens, np.int32))):
                path = (*path, turn)
                assert path not in nodes  # every node of the tree is written once
                nodes.add(path)
            whole += r.tokens
    if most == 10**6:
        assert len(by_sequence) <= 8
        assert segments.agg(F.sum(F.size("tokens"))).first()[0] < 0.5 * sum(
            len(tokens.ids("".join(chat_format.turn_parts(r or "", t or "")))) for _, _, r, t in rows if t != "long " * 60000
        ) + len(tokens.ids("long " * 60000)) + 100


def test_no_conversations(spark):
    segments, convs = chat_format.formatted_conversations(spark.createDataFrame([], SCHEMA), PATH, PATTERN)
    assert segments.count() == 0 and convs.count() == 0 and chat_format.read_back(segments, PATH, PATTERN).count() == 0
