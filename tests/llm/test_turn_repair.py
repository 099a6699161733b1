"""Conversation repair against plain dynamic programming over whole edit scripts."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from quire.llm import turn_repair
from quire.llm.queries import QUERIES, damaged

SOLID = re.compile("[^\x20\x09-\x0d]")
LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest int, conv long"


def cheapest(rows):
    """Least (cost, audit) over all scripts, by recursion on suffixes that keeps the least string."""
    @lru_cache(None)
    def best(i, state, inserts):
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "", ("e", "u"): "u"}
        wanted = "a" if state == "u" else "u"

        def after(letter):
            to = step.get(("e" if state == "e" else state, letter))
            return None if to is None else ("e" if (state, letter) == ("u", "a") else to)

        found = []
        if i == len(rows) and state in ("", "e"):
            found.append((0, ""))
        if inserts < 3:
            cost, audit = best(i, after(wanted), inserts + 1)
            found.append((cost + 5, "I" + audit))
        if i < len(rows):
            initial, gone, cut = rows[i]
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit))
            if not gone:
                cost, audit = best(i + 1, after(wanted), 0)
                found.append((cost + 1 + 5 * cut, "R" + audit))
                if initial and after(initial):
                    cost, audit = best(i + 1, after(initial), 0)
                    found.append((cost + 5 * cut, "K" + audit))
        return min(found, default=(10**6, ""))
    return best(0, "", 0)


def brute(rows):
    """One conversation's result from its (turn, role, text) rows after damage, in order."""
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, told, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        blank, again = not SOLID.search(text), (role, text) in seen
        cut = not blank and SOLID.findall(text)[-1] not in ".!?"
        seen.add((role, text))
        for i, fault in enumerate((blank, again, cut)):
            if fault:
                counts[i] += 1
                break
        told.append((role[:1], blank or again, cut and not again))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(tuple(told))
    out, at, state = [], 0, 0
    for letter in audit:
        if letter == "I":
            out.append((("user", "assistant")[state], ""))
            state ^= 1
            continue
        _, role, text = rows[at]
        at += 1
        if letter == "R":
            role = ("user", "assistant")[state]
        if letter != "D":
            out.append((role, text))
            state = int(role[:1] == "u")
    assert at == len(rows) and LEGAL.fullmatch("".join(r[0] for r, _ in out))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *counts, illegal, cost, audit, digest)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    left = {}
    for conv, turn, role, text in damage(rows):
        left.setdefault(conv, []).append((turn, role, text))
    def order(row):  # equal turns by role, then by digest
        turn, role, text = row
        return turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    return {c: brute(sorted(left.get(c, []), key=order)) for c in {r[0] for r in rows}}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_block_tables_equal_plain_recursion():
    rng = random.Random(5)
    for n in [*range(10), *[rng.randrange(30) for _ in range(600)]]:
        symbols = [rng.choice([0, 1, 2, 3, 3, 3, 4, 5, 5, 5, 6, 7, 8]) for _ in range(n)]
        rows = tuple(("" if s == 0 else "sua"[(s - 1) // 2:][:1], s == 0, s > 0 and (s - 1) % 2 == 1) for s in symbols)
        assert turn_repair.tables().repair(np.array(symbols, np.int64)) == cheapest(rows)
    assert turn_repair.tables(3).repair(np.array([3] * 7)) == turn_repair.tables().repair(np.array([3] * 7))
    cost, audit = turn_repair.tables().repair(np.array([3, 5] * 200_000))
    assert (cost, audit) == (0, "K" * 400_000)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_restatement(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_conversation_repair"](spark, path).collect()}
    assert got == expected(rows)


def test_odd_conversations(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(-3, 60):
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            role = rng.choice(["user", "assistant", "system", None, "", "tool", "admin", "ünder"])
            text = rng.choice([None, "", " \n\t", "Yes.", "No", "Yes. \n", "é ", "a.b", "x" * 9000 + "!", "."])
            rows.append((conv, rng.choice([None, *range(-1, 6)]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None), (7, None, None, None)]
    rows += [(100 + i, t, r, "Same.") for i in range(300) for t, r in enumerate(["user", "assistant"])]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    got = {r.conv: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair_conversations(damaged(frame), frame).collect()}
    want = expected(rows)
    assert len(want) > 300 and got == want
    again = {r.conv: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair_conversations(damaged(frame.repartition(7)), frame).collect()}
    assert again == got


def test_no_rows_and_one_long_conversation(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair_conversations(none, none).count() == 0
    only = turn_repair.repair_conversations(none, spark.createDataFrame([(1,)], "conv_id long")).first()
    assert tuple(only)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    long = spark.range(60_000).selectExpr(
        "5L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('Turn ', id, IF(id % 1000 = 7, '', '.')) AS text"
    )
    rows = [(r.turn, r.role, r.text) for r in long.orderBy("turn").collect()]
    judged = turn_repair.audits(long).first()
    assert judged.truncated == 60 and len(judged.audit) == 60_000
    assert judged.cost == 2 * 2 * 60 and judged.audit.count("D") == 120
    texts = turn_repair.repaired(long, turn_repair.audits(long)).orderBy("position").collect()
    left = [r for r, letter in zip(rows, judged.audit, strict=True) if letter != "D"]
    assert [(r.role, r.text) for r in texts] == [(b, c) for _, b, c in left]
