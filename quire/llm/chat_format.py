"""Chat formatting by a prefix tree: conversations that begin alike share the tokens of their common turns.

Sorted by the digests of their turns, conversations stand in the depth-first order of the tree of their turns: what a
conversation shares with the one before it is the path to where it branches off, and the turns behind are new nodes. So
one pass over the sorted conversations emits every node once, with the positions its tokens have in their conversation
and the spans of the sequence that hold its ancestors; a token attends to these spans and to its own segment up to itself.

A turn is written `### role: text</turn>` and a line feed. A backslash stands before every backslash, number sign and
`</turn>` that a text or role has, and before every colon of a role; so no text can end a turn or begin another.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

MAX_TOKENS = 65_536  # a sequence takes no further conversation once it is that long
TEXT = re.compile(r"\\|#|</turn>")
ROLE = re.compile(r"\\|#|</turn>|:")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.DOTALL)
TRAINED = "assistant"


def escape(text: str, control: re.Pattern = TEXT) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the text as written, and what stands behind."""
    return f"### {escape(role, ROLE)}: ", escape(text), "</turn>\n"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; anything else between them is an error."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside of a turn")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text behind the last turn")
    return out


class Tokenizer:
    """A byte-level encoding from a file of ranks; control strings have no ids of their own."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.fixed = lru_cache(4096)(self.ids)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode()


@lru_cache(4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def paths(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv, path, turns): every conversation's turns in order, and a digest of each.

    Rows are taken by turn, null turns first, then by role and text; null roles and texts are empty. A row of a null id
    is a conversation of its own.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(id_col).alias("conv"), alone.alias("alone"), turn.alias("row"))
    held = rows.groupBy("conv", "alone").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # one conversation's own turns
    digest = F.transform("rows", lambda r: F.unhex(F.sha2(F.concat(F.length(r["role"]).cast("string"), F.lit(":"), r["role"], r["text"]), 256)))
    said = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    keyed = held.select("conv", digest.alias("path"), said.alias("turns"))
    return keyed.withColumn("path_key", F.unhex(F.sha2(F.array_join(F.transform("path", F.hex), ""), 256)))


SPANS = "array<struct<start:int,end:int>>"
SEGMENT = (
    f"sequence long, start int, path_key binary, tokens array<int>, positions array<int>, ancestors {SPANS}, loss {SPANS}"
)
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SEGMENT = pa.schema([
    ("sequence", pa.int64()), ("start", pa.int32()), ("path_key", pa.binary()), ("tokens", pa.list_(pa.int32())),
    ("positions", pa.list_(pa.int32())), ("ancestors", _SPAN), ("loss", _SPAN),
])


def joined(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans in order, those that touch as one."""
    out: list[list[int]] = []
    for start, end in spans:
        if out and out[-1][1] == start:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def sequences(conversations: DataFrame, path: str, pattern: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(sequence, start, path_key, tokens, positions, ancestors, loss): a row for every different conversation.

    The tokens of a sequence are those of its rows by start. A row holds the turns that no earlier row of its sequence
    has: their tokens, the position of each in the conversation, the spans of the sequence that hold the turns before
    them (the conversation is those spans and then the row's own tokens), and the spans whose tokens are trained on, the
    texts of `assistant` turns, counted in the sequence. A conversation that begins another one of its sequence
    has its own, empty row if it stands behind, and none of its turns is written twice.

    Equal conversations are one row; they are merged before the shuffle. Conversations are dealt out by range of
    their digests, so a first turn that very many share is spread over tasks. Sequences end at the borders of tasks and
    after max_tokens; the path to the next conversation is then written anew, which is the only repetition.
    """
    different = conversations.groupBy("path_key").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    ordered = different.repartitionByRange("path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(path, pattern)
        sequence, length = TaskContext.get().partitionId() << 32, 0
        before: list[bytes] = []
        nodes: list[tuple[int, int]] = []  # the spans of the last conversation's turns
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                if length >= max_tokens:
                    sequence, length, before, nodes = sequence + 1, 0, [], []
                shared = 0
                while shared < min(len(before), len(row["path"])) and before[shared] == row["path"][shared]:
                    shared += 1
                del nodes[shared:]
                start, parts, loss = length, [], []
                first = sum(b - a for a, b in nodes)
                for turn in row["turns"][shared:]:
                    head, text, tail = turn_parts(turn["role"], turn["text"])
                    pieces = [tokens.fixed(head), tokens.ids(text), tokens.fixed(tail)]
                    if turn["role"] == TRAINED and len(pieces[1]):
                        loss.append({"start": length + len(pieces[0]), "end": length + len(pieces[0]) + len(pieces[1])})
                    end = length + sum(map(len, pieces))
                    nodes.append((length, end))
                    length = end
                    parts += pieces
                before = row["path"]
                own = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                out.append({
                    "sequence": sequence, "start": start, "path_key": row["path_key"], "tokens": own,
                    "positions": np.arange(first, first + len(own), dtype=np.int32), "ancestors": joined(nodes[:shared]), "loss": loss,
                })
                size += len(own)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT)

    return ordered.select("path_key", "path", "turns").mapInArrow(run, SEGMENT)


READ = (
    "path_key binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_READ = pa.schema([
    ("path_key", pa.binary()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def read_back(segments: DataFrame, path: str, pattern: str) -> DataFrame:
    """(path_key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every different conversation, found
    from the tokens, spans and loss of its sequence alone."""

    def spans(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First entry of each row, and the start and end of all."""
        held = column.combine_chunks()
        inner = held.flatten()
        lengths = held.value_lengths().to_numpy(zero_copy_only=False)
        return np.append(0, np.cumsum(lengths)), inner.field("start").to_numpy(), inner.field("end").to_numpy()

    def run(rows: pa.Table) -> pa.Table:
        tokens, out = tokenizer(path, pattern), []
        own = rows["tokens"].combine_chunks()
        starts, lengths = rows["start"].to_numpy(), own.value_lengths().to_numpy(zero_copy_only=False)
        flat, offsets = own.flatten().to_numpy(), np.append(0, np.cumsum(lengths))
        whole = np.zeros(int((starts + lengths).max()), np.int32)
        for i, (a, n) in enumerate(zip(starts, lengths, strict=True)):
            whole[a:a + n] = flat[offsets[i]:offsets[i + 1]]
        trained = np.zeros(len(whole), bool)
        for a, b in zip(*spans(rows["loss"])[1:], strict=True):
            trained[a:b] = True
        first, froms, tos = spans(rows["ancestors"])
        for i, key in enumerate(rows["path_key"].to_pylist()):
            held = [slice(a, b) for a, b in zip(froms[first[i]:first[i + 1]], tos[first[i]:first[i + 1]], strict=True)]
            held.append(slice(starts[i], starts[i] + lengths[i]))
            ids, mask = (np.concatenate([x[s] for s in held]) for x in (whole, trained))
            formatted, learnt = tokens.text(ids), unescape(tokens.text(ids[mask]))
            turns = turns_of(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((
                key, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt),
                hashlib.sha256(learnt.encode()).hexdigest(), len(formatted),
            ))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)

    segments = segments.select("sequence", "start", "path_key", "tokens", "ancestors", "loss")
    return segments.groupBy("sequence").applyInArrow(run, READ)  # a sequence is max_tokens and one conversation at most


def formatted_conversations(turns: DataFrame, path: str, pattern: str, id_col: str = "conv_id", turn_col: str = "turn",
                            role_col: str = "role", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The sequences of all conversations (see `sequences`), and (conv, path_key): the row each conversation ends in."""
    held = stored(paths(turns, id_col, turn_col, role_col, text_col), "conversations")
    return stored(sequences(held, path, pattern, max_tokens), "sequences"), held.select("conv", "path_key")
