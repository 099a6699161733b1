"""Byte-level BPE: pieces are merged under a segment tree of pair ranks, then decoded again."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

NONE = np.int64(1) << 62
LONG = 256  # bytes of a piece that is merged alone
KEPT = 200_000  # pieces whose tokens a worker remembers


class Ranks:
    """A vocabulary of byte strings with ranks, and the rank of every pair of its tokens whose bytes join to a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        self.decimals = {rank: str(rank) for rank in self.tokens}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        keys, ranks = [], []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.dictionary: dict[int, int] = {}
        self.pairs, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]

    def by_pair(self) -> dict[int, int]:
        """The same ranks as a dictionary, for single look-ups; made when first asked for."""
        if not self.dictionary:
            self.dictionary = dict(zip(self.pairs.tolist(), self.pair_ranks.tolist(), strict=True))
        return self.dictionary

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where its bytes are no token."""
        key = a << np.int64(32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE)


def merge(pieces: list[bytes], ranks: Ranks) -> list[tuple[int, ...]]:
    """The tokens of pieces of similar length, merged side by side.

    A row of `tree` is the segment tree of one piece: leaf i holds the rank of the pair that starts at byte i, joined
    with i, so the root names the leftmost pair of least rank. A merge changes the leaf where it happens, the leaf of
    the live neighbour before it and that of the token it takes in, each with the path to the root.
    """
    n, width = len(pieces), max(2, 1 << (max(map(len, pieces)) - 1).bit_length())
    ids = np.full((n, width), -1, np.int64)
    for i, piece in enumerate(pieces):
        ids[i, : len(piece)] = ranks.single[np.frombuffer(piece, np.uint8)]
    size = np.array([len(p) for p in pieces])
    place = np.arange(width)
    after = np.broadcast_to(place + 1, (n, width)).copy()
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    pair = ranks.of(ids[:, :-1].clip(0), ids[:, 1:].clip(0))
    pair[place[None, 1:] >= size[:, None]] = NONE
    tree[:, width : 2 * width - 1] = np.where(pair < NONE, pair * width + place[:-1], NONE)
    level = width // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[row, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def renew(row: np.ndarray, left: np.ndarray) -> None:
        right = after[row, left]
        live = right < size[row]
        rank = ranks.of(ids[row, left], ids[row, np.where(live, right, left)])
        put(row, left, np.where(live & (rank < NONE), rank * width + left, NONE))

    while len(row := np.flatnonzero(tree[:, 1] < NONE)):
        left = tree[row, 1] % width
        right = after[row, left]
        ids[row, left] = tree[row, 1] // width
        ids[row, right] = -1
        then = after[row, right]
        after[row, left] = then
        inner = then < size[row]
        before[row[inner], then[inner]] = left[inner]
        put(row, right, np.full(len(row), NONE))
        renew(row, left)
        prior = before[row, left]
        if len(some := np.flatnonzero(prior >= 0)):
            renew(row[some], prior[some])
    return [tuple(x[x >= 0].tolist()) for x in ids]


def merge_long(piece: bytes, ranks: Ranks) -> tuple[int, ...]:
    """The tokens of one long piece, under a segment tree as in `merge`, without its rows side by side.

    A node holds the least pair rank below it; the leftmost leaf of the root's rank is found from the top. Tree, ids and
    neighbours are arrays of four-byte numbers: 20 to 28 bytes for each byte of the piece. A change goes up as far as it
    changes a least rank.
    """
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none, of = (1 << 31) - 1, ranks.by_pair()
    tree = np.full(2 * width, none, np.int32)
    own = ranks.single[np.frombuffer(piece, np.uint8)]
    for at in range(0, n - 1, 1 << 20):
        to = min(n - 1, at + (1 << 20))
        tree[width + at : width + to] = np.minimum(ranks.of(own[at:to], own[at + 1 : to + 1]), none)
    level = width // 2
    while level:
        np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2], out=tree[level : 2 * level])
        level //= 2
    own, after, before = own.astype(np.int32), np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    least, ids, nexts, priors = (memoryview(x) for x in (tree, own, after, before))

    def put(leaf: int, rank: int) -> None:
        node = leaf + width
        least[node] = rank
        while node > 1:
            a, b = least[node], least[node ^ 1]
            node >>= 1
            if b < a:
                a = b
            if least[node] == a:
                break
            least[node] = a

    def renew(left: int) -> None:
        right = nexts[left]
        put(left, of.get(ids[left] << 32 | ids[right], none) if right < n else none)

    while (rank := least[1]) != none:
        node = 1
        while node < width:
            node *= 2
            if least[node] != rank:
                node += 1
        left = node - width
        right = nexts[left]
        then = nexts[left] = nexts[right]
        ids[left], ids[right] = rank, -1
        if then < n:
            priors[then] = left
        put(right, none)
        renew(left)
        if priors[left] >= 0:
            renew(priors[left])
    return tuple(own[own >= 0].tolist())


class Codec:
    """Encodes and decodes texts; remembers the tokens of pieces it has met, up to a bound."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.split = Ranks(path), regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Looks new pieces up, or merges them with others of similar length."""
        if len(self.known) > KEPT:
            self.known.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.ids.get(raw)
            if rank is not None:
                self.known[piece] = (rank,)
            elif len(raw) > LONG:
                self.known[piece] = merge_long(raw, self.ranks)
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, group in by_width.items():
            step = max(1, (1 << 16) >> width)
            for at in range(0, len(group), step):
                some = group[at : at + step]
                self.known.update(zip((p for p, _ in some), merge([raw for _, raw in some], self.ranks), strict=True))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of every text, special tokens treated as ordinary text."""
        for at in range(0, len(texts), 256):
            split = [self.split(text or "") for text in texts[at : at + 256]]
            if len(self.known) > KEPT:
                self.known.clear()
            fresh = set().union(*split).difference(self.known)
            if fresh:
                self.learn(fresh)
            known = self.known
            for pieces in split:
                yield list(chain.from_iterable([known[p] for p in pieces]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))

    def digests(self, ids: list[int], decoded: bytes) -> tuple[int, str, str]:
        """Their number, and the digests of their decimals, joined by blanks, and of the bytes."""
        decimals = " ".join(map(self.ranks.decimals.__getitem__, ids))
        return len(ids), hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker for a vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _over(docs: DataFrame, path: str, pattern: str, text_col: str, columns: str,
          make: Callable[[Codec, list[int], bytes], tuple]) -> DataFrame:
    """The documents with what `make` gives for each text's ids and decoded bytes."""
    extra = docs.sparkSession.createDataFrame([], columns).schema
    docs = docs.drop(*extra.names)
    schema = docs.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra]).schema

    types = [to_arrow_type(f.dataType) for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                rows = [make(own, ids, own.decode(ids)) for ids in own.encode(part.column(text_col).to_pylist())]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *extra.names])

    return docs.mapInArrow(run, schema)


def with_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids",
                decoded_col: str = "decoded") -> DataFrame:
    """The documents with their token ids and the bytes these decode to.

    Each match of the pattern is encoded alone: a match that is a token is that token, any other starts as single bytes
    and merges the pair of least rank, leftmost first, until no pair is a token. Null and empty texts have no ids.
    The vocabulary is read on every executor from `path`. Rows are independent: repeated rows repeat their result.
    """
    return _over(docs, path, pattern, text_col, f"{ids_col} array<int>, {decoded_col} binary", lambda own, ids, raw: (ids, raw))


def with_token_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The documents with n_tokens, ids_sha256 (of the decimal ids, joined by blanks) and decoded_sha256 in place of the
    ids themselves; see with_tokens."""
    return _over(docs, path, pattern, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", Codec.digests)
