"""Collapsing equal byte strings by recursive radix partitioning and per-bucket tries.

1. Split: rows are counted by the first bytes of their key. A bucket of more than ``capacity`` rows is
   split by the bytes that follow what all its keys begin with, level by level, until every bucket fits
   or holds one key alone. A beginning that many keys share costs no level of its own. Buckets are told
   by a hash of their bytes; the tables of oversized buckets (at most rows/capacity rows a level) stay
   distributed and are broadcast only below a bound.
2. Count: rows go to the task of their bucket, where a trie holds the keys. Its terminals count the
   copies and keep the smallest id.
3. A key that fills a bucket by itself (a hot group) cannot be split by bytes. It is a trie of one
   terminal, which is counted where its rows lie and added up; the rows then look up their total.

Defined cases
- null key: not a record, left out. Empty key: a key like any other.
- ties cannot arise, ids are unique; a repeated id counts as often as it comes.
- an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from refloom.plans.lineage import cut
from refloom.plans.skew import lookup_join

#: Rows that one bucket's trie may hold: a few hundred bytes each, well within a Python worker.
CAPACITY = 20_000
#: Bytes by which a bucket is split.
STEP = 2
#: Oversized buckets that are broadcast, 20 bytes each; more of them take a shuffle join.
BROADCAST_ROWS = 100_000
#: Levels after which the rows are written anew, so that plans stay small.
LEVELS_A_CUT = 4


class Trie:
    """Byte trie with path compression; terminals hold [count, smallest id]."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, n: int, least: int) -> list[int]:
        """Count ``n`` more rows of ``key``; returns its terminal."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                cell = node.get(-1)
                if cell is None:
                    cell = node[-1] = [0, least]
                break
            edge = node.get(key[at])
            if edge is None:
                cell = [0, least]
                node[key[at]] = (key[at:], {-1: cell})
                break
            label, child = edge
            rest = key[at:]
            if rest.startswith(label):
                node, at = child, at + len(label)
                continue
            k = next((i for i, (x, y) in enumerate(zip(label, rest, strict=False)) if x != y), min(len(label), len(rest)))
            middle = {label[k]: (label[k:], child)}
            node[key[at]] = (label[:k], middle)
            node, at = middle, at + k
        cell[0] += n
        cell[1] = min(cell[1], least)
        return cell


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the keys of a bucket part: length of what its least and its greatest key share."""
    for b in batches:
        widths = []
        for x, y in zip(b.column("a").to_pylist(), b.column("z").to_pylist(), strict=True):
            widths.append(next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))))
        hot = [x == y for x, y in zip(b.column("a").to_pylist(), b.column("z").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("bucket"), pa.array(widths, pa.int32()), pa.array(hot, pa.bool_())], names=["bucket", "shared", "alone"])


def oversized(rows: DataFrame, capacity: int) -> DataFrame:
    """(bucket, shared, alone) of buckets with more than ``capacity`` rows: bytes that all keys share, and whether there is one key only."""
    ends = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).filter(F.col("n") > capacity)
    return ends.select("bucket", "a", "z").mapInArrow(_branch, "bucket bigint, shared int, alone boolean")


def _with(rows: DataFrame, buckets: DataFrame, n: int) -> DataFrame:
    """Rows with the facts of their bucket, if there are any."""
    return rows.join(F.broadcast(buckets), "bucket", "left") if n <= BROADCAST_ROWS else lookup_join(rows, buckets, "bucket")


def bucketed(rows: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> tuple[DataFrame, int]:
    """(id, key, bucket, hot) of (id, key), and the number of levels: no bucket but hot ones, of one key each, has more than ``capacity`` rows."""
    placed = rows.select("id", "key", F.xxhash64(F.substring("key", 1, step)).alias("bucket"), F.lit(False).alias("hot"))
    level = 0
    while True:
        big = cut(oversized(placed.filter("not hot"), capacity))
        n = big.count()
        if not n:
            return placed, level
        level += 1
        finer = F.xxhash64("bucket", F.expr(f"substring(key, 1, shared + {step})"))
        marked = _with(placed, big, n)
        placed = marked.select("id", "key", F.when(F.col("alone") | F.col("shared").isNull(), F.col("bucket")).otherwise(finer).alias("bucket"), (F.col("hot") | F.coalesce("alone", F.lit(False))).alias("hot"))
        if level % LEVELS_A_CUT == 0:
            placed = cut(placed)


def _count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one bucket with the count and smallest id of their key."""
    trie = Trie()
    cells = [trie.add(bytes(k), 1, int(i)) for k, i in zip(pdf["key"], pdf["id"], strict=True)]
    return pd.DataFrame({"id": pdf["id"].to_numpy(), "n_copies": [c[0] for c in cells], "first_id": [c[1] for c in cells]})


def copies(records: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """(id, n_copies, first_id) of every row of ``records`` (id bigint, key binary) with a key."""
    placed, levels = bucketed(cut(records.select("id", "key").filter("key is not null")), capacity, step)
    # Small buckets share tasks: the shuffle is by bucket, and AQE joins small partitions.
    out = placed.filter("not hot").select("id", "key", "bucket").groupBy("bucket").applyInPandas(_count_bucket, "id bigint, n_copies bigint, first_id bigint")
    if not levels:
        return out
    hot = cut(placed.filter("hot").select("id", "bucket"))
    totals = cut(hot.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("first_id")))
    return out.unionByName(_with(hot, totals, totals.count()).select("id", "n_copies", "first_id"))
