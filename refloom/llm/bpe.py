"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

A text is split into pieces by the vocabulary's pattern; each piece is merged on its own. The leaves
of a segment tree hold the rank of the pair that starts at each byte; the root gives the leftmost pair
of lowest rank. A merge changes the leaves of the pair itself, of its left neighbour and of the part
swallowed, each in logarithmic time, until no pair can be merged.

Defined cases
- null and empty text: the empty list. Strings that look like control tokens are ordinary text.
- unpaired surrogates become the replacement character, as UTF-8 cannot hold them.
- pieces of any length are merged whole, in n log n; short pieces are remembered, a bounded number.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = os.environ.get("REFLOOM_TOKENIZERS", "/opt/tokenizers")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How each vocabulary cuts a text into pieces; no other vocabulary can be asked for.
PATTERNS = {"byte_bpe_50k": PATTERN}
#: Pieces remembered by a worker, and their greatest length in bytes.
REMEMBERED, REMEMBERED_BYTES = 200_000, 48


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line per token, base64 and rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    none = 1 << 60
    tree = [none] * (2 * size)
    end = list(range(1, n + 1))  # where the part that starts here ends
    start = list(range(-1, n - 1))  # where the part to the left starts
    get = ranks.get

    def key(i: int) -> int:
        j = end[i]
        if j >= n:
            return none
        r = get(piece[i : end[j]])
        return none if r is None else (r << 32) | i

    for i in range(n - 1):
        tree[size + i] = key(i)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, v: int) -> None:
        k = size + i
        tree[k] = v
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a <= b else b
            if tree[k] == m:
                return
            tree[k] = m
            k >>= 1

    while tree[1] != none:
        i = tree[1] & 0xFFFFFFFF
        j = end[i]
        end[i] = end[j]
        if end[j] < n:
            start[end[j]] = i
        put(j, none)
        put(i, key(i))
        if start[i] >= 0:
            put(start[i], key(start[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; remembers short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.split, self.known = ranks, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace") if piece.isascii() else piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
                ids = merge(raw, self.ranks)
                if len(raw) <= REMEMBERED_BYTES and len(known) < REMEMBERED:
                    known[piece] = ids
            out += ids
        return out


def decode(ids: list[int], ranks: dict[bytes, int]) -> bytes:
    tokens = {r: t for t, r in ranks.items()}
    return b"".join(tokens[i] for i in ids)


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None) -> Broadcast:
    """The vocabulary file's bytes for all workers; a file of about a megabyte, whatever the data.

    Names whose pattern is not known raise ValueError.
    """
    if name not in PATTERNS:
        raise ValueError(f"no pattern known for vocabulary {name!r}")
    with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(texts: DataFrame, vocab: Broadcast, counts_only: bool = False) -> DataFrame:
    """(id, text) -> (id, ids array<int>) or (id, n_tokens bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(read_ranks(vocab.value))
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            col = pa.array([len(x) for x in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), col], names=["id", "n_tokens" if counts_only else "ids"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, n_tokens bigint" if counts_only else "id bigint, ids array<int>")
