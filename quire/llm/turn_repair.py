"""Conversation structure repair: the cheapest edits to legal turns, by block tables of normalised cost vectors.

A conversation is legal if its role initials are nothing, or an optional s and then one or more pairs ua. The cost of
repairing what is left of a conversation depends only on the state of that pattern, so it is a vector of four numbers,
and vectors that differ by a constant behave alike. There are few normalised vectors; what a block of BLOCK rows makes of
each of them is computed once for every possible block (Four Russians) and looked up from then on, right to left. The
edits are found left to right: each block is expanded backward from its right border, and of the edits that keep the
cost the one of the least letter is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, stored

BLOCK = 4
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5

START, SYSTEM, USER, ASSISTANT = range(4)  # what has been read: nothing, s, an open u, a closed pair
STEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
WANTED = (1, 1, 2, 1)  # the initial that an inserted or renamed turn has in each state
AFTER = tuple(STEP[q, WANTED[q]] for q in range(4))
ROLES = {1: "user", 2: "assistant"}

#: Symbols: a turn that must go; the initials s, u, a and others, each whole or truncated; and nothing, to fill a block.
GONE, NOTHING, SYMBOLS = 0, 9, 10


def closed(costs: list[int]) -> list[int]:
    """Costs by state when turns may be inserted first."""
    costs = list(costs)
    for _ in range(3):
        costs = [min(c, INSERT + costs[AFTER[q]]) for q, c in enumerate(costs)]
    return costs


TERMINAL = tuple(closed([0, 1 << 20, 1 << 20, 0]))


def before(costs: tuple[int, ...], symbol: int) -> list[int]:
    """Costs by state in front of a turn, from those behind it."""
    if symbol == NOTHING:
        return list(costs)
    out = []
    for q in range(4):
        best = DELETE + costs[q]
        if symbol != GONE:
            initial, cut = divmod(symbol - 1, 2)
            best = min(best, REROLE + TRUNCATED * cut + costs[AFTER[q]])
            if (q, initial) in STEP:
                best = min(best, TRUNCATED * cut + costs[STEP[q, initial]])
        out.append(best)
    return closed(out)


class Tables:
    """The normalised vectors, what each symbol makes of them, and what each block of BLOCK symbols does."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        self.vectors, names = [TERMINAL], {TERMINAL: 0}
        one: list[list[tuple[int, int]]] = []
        while len(one) < len(self.vectors):
            row = []
            for symbol in range(SYMBOLS):
                costs = before(self.vectors[len(one)], symbol)
                low = min(costs)
                vector = tuple(c - low for c in costs)
                if vector not in names:
                    names[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append((names[vector], low))
            one.append(row)
        self.one = one
        first = np.array(one, np.int32)
        to, cost = first[:, :, 0], first[:, :, 1]
        self.to, self.cost = to, cost
        for _ in range(block - 1):  # one symbol more at the left
            self.cost = (self.cost[:, None, :] + cost[self.to].transpose(0, 2, 1)).reshape(len(one), -1)
            self.to = to[self.to].transpose(0, 2, 1).reshape(len(one), -1)
        self.trace = lru_cache(1 << 16)(self._trace)

    def _trace(self, code: int, border: int, state: int) -> tuple[str, int]:
        """Letters of the edits in a block and the state behind it, given the vector at its right border."""
        symbols = [code // SYMBOLS**i % SYMBOLS for i in reversed(range(self.block))]
        inner = [border]
        for symbol in reversed(symbols):
            inner.append(self.one[inner[-1]][symbol][0])
        inner.reverse()
        letters = []
        for i, symbol in enumerate(symbols):
            if symbol == NOTHING:
                continue
            behind = self.vectors[inner[i + 1]]
            here = [c + self.one[inner[i + 1]][symbol][1] for c in self.vectors[inner[i]]]
            while here[state] != DELETE + behind[state] and here[state] == INSERT + here[AFTER[state]]:
                letters.append("I")
                state = AFTER[state]
            if here[state] == DELETE + behind[state]:
                letters.append("D")
                continue
            initial, cut = divmod(symbol - 1, 2)
            to = STEP.get((state, initial))
            if to is not None and here[state] == TRUNCATED * cut + behind[to]:
                letters.append("K")
                state = to
            else:
                letters.append("R")
                state = AFTER[state]
        return "".join(letters), state

    def repair(self, symbols: np.ndarray) -> tuple[int, str]:
        """The least cost, and of the edits that have it the letters that come first."""
        lead = -len(symbols) % self.block
        filled = np.concatenate([np.full(lead, NOTHING, np.int64), symbols.astype(np.int64)])
        codes = (filled.reshape(-1, self.block) @ SYMBOLS ** np.arange(self.block)[::-1]).tolist()
        vector, total, borders = 0, 0, []
        for code in reversed(codes):
            borders.append(vector)
            total += int(self.cost[vector, code])
            vector = int(self.to[vector, code])
        total += self.vectors[vector][START]
        state, parts = START, []
        for code, border in zip(codes, reversed(borders), strict=True):
            letters, state = self.trace(code, border, state)
            parts.append(letters)
        while TERMINAL[state]:
            parts.append("I")
            state = AFTER[state]
        return total, "".join(parts)


@lru_cache(4)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _faults(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, digest of role and text, whether blank, whether cut short, class of the initial."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    tail = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    initial = F.coalesce(*[F.when(_initial(F.col("role")) == c, F.lit(i)) for i, c in enumerate("sua")], F.lit(3))
    return rows.select(
        "*", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
        (~F.col("text").rlike(WORD)).alias("blank"), (~tail.isin(".", "!", "?")).alias("cut"), initial.alias("initial"),
    )


AUDIT = "n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [c.split()[0] for c in AUDIT.split(", ")]


def _judge(pieces: list[pa.RecordBatch]) -> tuple:
    """One conversation's audit from its rows in order."""
    table = pa.Table.from_batches(pieces)
    turns = table["turn"].drop_null()
    gaps = 0
    if len(turns):
        low, high = turns[0].as_py(), turns[len(turns) - 1].as_py()
        gaps = high - low + 1 - len(turns.unique())
    digests = table["digest"].combine_chunks().dictionary_encode().indices.to_numpy()
    repeated = np.ones(len(digests), bool)
    repeated[np.unique(digests, return_index=True)[1]] = False
    blank, cut = (table[c].to_numpy() for c in ("blank", "cut"))
    initial = table["initial"].to_numpy()
    gone = blank | repeated
    symbols = np.where(gone, GONE, 1 + 2 * initial + cut)
    a, b = initial[:-1], initial[1:]
    legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    cost, audit = tables().repair(symbols)
    return (len(digests), gaps, int(blank.sum()), int((repeated & ~blank).sum()), int((cut & ~gone).sum()),
            int((~legal).sum()), cost, audit)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, its rows in pieces) for rows that stand in order of their conversation."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        ids = batch.column(0).to_pylist()
        start = 0
        for i in range(len(ids) + 1):
            if i < len(ids) and i and ids[i] == ids[i - 1]:
                continue
            if i > start:
                held.append(batch.slice(start, i - start))
                start = i
            if i < len(ids) and held and ids[i] != key:
                yield key, held
                held = []
            if i < len(ids):
                key = ids[i]
    if held:
        yield key, held


def audits(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation that has rows.

    Rows are taken by turn, null turns first, equal turns by role and then by a digest of role and text. A row's first
    fault counts: blank (no character but white space), duplicate (role and text as in an earlier row), truncated (its
    last such character is not one of .!?). gaps counts the turns missing between the least and the greatest; illegal
    counts neighbours whose initials are not su, ua or au. cost and audit are the cheapest edits to a legal
    conversation: K keeps a turn (0), R names it user or assistant (1), D deletes it (2, the only edit for blank and
    duplicate turns), I inserts an empty user or assistant turn (5); a truncated turn that stays costs 5 more. Of edits
    that cost the same, those whose letters come first. Null roles and texts count as one space; only the first
    character of a role is looked at. Rows of a null id are one conversation of a null id. No rows: none.

    Texts are digested before the shuffle. A conversation's rows stream through one task in order; that task holds a
    few bytes of each of its rows and no text.
    """
    rows = _faults(turns, id_col, turn_col, role_col, text_col).drop("text")
    kind = dict(turns.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in _conversations(batches):
            told = _judge(pieces)
            yield pa.RecordBatch.from_pydict({"conv": pa.array([key], pieces[0].schema.field(0).type)} | {
                n: [v] for n, v in zip(_NAMES, told, strict=True)
            })

    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.mapInArrow(_gathered(run), f"conv {kind}, {AUDIT}")


def _gathered(run, rows: int = 4096):
    """The same rows in larger batches."""
    def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in run(batches):
            held.append(batch)
            if len(held) >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return larger


REPAIRED = pa.schema([("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def repaired(turns: DataFrame, judged: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(conv, position, edit, role, text): the turns of every repaired conversation, by what `audits` found for it.

    The rows of a conversation follow each other in one partition, in order. Its audit comes before its turns, which
    then stream past: the task holds the audit and one batch of texts. Deleted turns have no row; a conversation of
    which nothing is left has none.
    """
    kind = dict(turns.dtypes)[id_col]
    rows = _faults(turns, id_col, turn_col, role_col, text_col).select(
        "conv", F.lit(1).alias("part"), "turn", "role", "text", "digest", F.lit(None).cast("string").alias("audit")
    )
    heads = judged.select(
        "conv", F.lit(0).alias("part"), F.lit(None).cast(dict(turns.dtypes)[turn_col]).alias("turn"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("digest", "binary"))], "audit",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, edits, at, state, position = None, "", 0, START, 0

        def inserted(out: list) -> None:
            nonlocal at, state, position
            while edits[at:at + 1] == "I":
                out.append((key, position, "I", ROLES[WANTED[state]], ""))
                at, state, position = at + 1, AFTER[state], position + 1

        for batch in batches:
            out: list[tuple] = []
            for conv, part, role, text, audit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part == 0:
                    inserted(out)
                    key, edits, at, state, position = conv, audit, 0, START, 0
                    continue
                inserted(out)
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                if edit == "K":
                    state = STEP[state, "sua".index(role[0])]
                else:
                    role, state = ROLES[WANTED[state]], AFTER[state]
                out.append((conv, position, edit, role, text))
                position += 1
            yield _batch(out, batch.schema.field(0))
        out = []
        inserted(out)
        if out:
            yield _batch(out, batch.schema.field(0))

    def _batch(out: list[tuple], first: pa.Field) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        fields = [pa.field("conv", first.type), *REPAIRED]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    both = rows.unionByName(heads).repartition("conv")
    ordered = both.sortWithinPartitions("conv", "part", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.select("conv", "part", "role", "text", "audit").mapInArrow(
        run, f"conv {kind}, position long, edit string, role string, text string"
    )


def text_digests(repaired_turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): lower-case digest of `role:text` of the repaired turns, joined by line feeds.

    Reads rows as `repaired` leaves them, in order within their partition; one running digest is held.
    """
    kind = dict(repaired_turns.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, kept = None, None, None
        for batch in batches:
            kept = batch.schema.field(0).type
            out = []
            for conv, position, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if position == 0:
                    if digest:
                        out.append((key, digest.hexdigest()))
                    key, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield _pair(out, kept)
        if digest:
            yield _pair([(key, digest.hexdigest())], kept)

    def _pair(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], names=["conv", "repaired_sha256"]
        )

    return repaired_turns.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


EMPTY_SHA = hashlib.sha256().hexdigest()


def repair_conversations(turns: DataFrame, ids: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every id in `ids`, each once;
    conversations without rows have zeros, an empty audit and the digest of nothing."""
    judged = stored(audits(turns, id_col, turn_col, role_col, text_col), "audits")
    digests = text_digests(repaired(turns, judged, id_col, turn_col, role_col, text_col))
    every = ids.select(F.col(id_col).alias("conv")).distinct()
    out = every.alias("e").join(judged.alias("j"), F.expr("e.conv <=> j.conv"), "left").join(
        digests.alias("d"), F.expr("e.conv <=> d.conv"), "left"
    )
    counts = [F.coalesce(F.col(f"j.{c}"), F.lit(0)).cast("long").alias(c) for c in _NAMES[1:-1]]
    return out.select(
        "e.conv", *counts, F.coalesce("j.audit", F.lit("")).alias("audit"),
        F.coalesce("d.repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )
