"""Self-join by prefix: which values are strict prefixes of longer values elsewhere, and which stand as a whole.

Values are compared through hashes of prefixes of fixed lengths. A value that is asked about has one key:
the hash of its longest prefix of such a length; what is left of it is its rest. The values of the corpus
give a key for each of those lengths, with the stretch that follows up to the next length. The two meet on
the key, and the value is a strict prefix if the stretch goes on after its rest. Neighbouring lengths are
close, so a key has few different stretches however many values share it, and they are combined before
they move. A filter of fixed size over the keys asked about keeps all other keys from being made into rows.

Defined cases
- null and empty values: left out. Equal values are one value; a value does not extend itself.
- comparison is by code point of the value as given; keys are 64 bits.
- an empty table gives an empty result. A value held by a third of all rows is combined map-side.
- a filter that is full lets all keys pass: slower, with the same result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from refloom.plans.lineage import cut
from refloom.plans.skew import salted_join

#: Bits of the filter over keys: one megabyte.
BITS = 1 << 23


def _lengths() -> tuple[int, ...]:
    """1 to 8, then a quarter longer each time."""
    out = list(range(1, 9))
    while out[-1] < 1 << 30:
        out.append(out[-1] + max(1, out[-1] // 4))
    return tuple(out)


LENGTHS = _lengths()


class Filter:
    """Set of hashed prefixes of fixed size; may hold more than was put in, never less."""

    def __init__(self, bits: bytes) -> None:
        self.bits = bits

    @staticmethod
    def of(asked: DataFrame) -> Filter:
        """Filter over the column ``place``."""
        bits = asked.groupBy(F.floor(F.col("place") / 8).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1, place % 8)")).alias("b"))
        out = bytearray(BITS // 8)
        for w, b in bits.collect():  # at most BITS / 8 rows
            out[w] = b
        return Filter(bytes(out))


def _key(kind: str, length: int, s: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{length}\x1f{s}".encode("utf-8", "surrogatepass")) - (1 << 63)


def prefix_key(kind: str, value: str) -> tuple[int, str, int]:
    """(key, rest, place in the filter) of a value that is asked about."""
    p = LENGTHS[bisect_right(LENGTHS, len(value)) - 1]
    return _key(kind, p, value[:p]), value[p:], crc32(value[:p].encode("utf-8", "surrogatepass"), crc32(kind.encode())) % BITS


def whole_key(kind: str, value: str) -> tuple[int, str]:
    """(key, rest) of a value that may stand as a whole."""
    return _key(kind, 0, value), ""


def asked_whole(kind: str, value: str) -> tuple[int, str, int]:
    """:func:`whole_key` with its place in the filter."""
    return *whole_key(kind, value), crc32(value.encode("utf-8", "surrogatepass"), crc32(("=" + kind).encode())) % BITS


def standing_keys(kind: str, value: str, wanted: Filter) -> Iterator[tuple[int, str]]:
    """(key, stretch) of a value that stands in the corpus, for :func:`prefix_key`, as far as the filter lets it pass."""
    n, sum_, bits, last = len(value), crc32(kind.encode()), wanted.bits, 0
    for k, p in enumerate(LENGTHS):
        if p > n:
            return
        sum_ = crc32(value[last:p].encode("utf-8", "surrogatepass"), sum_)
        last, at = p, sum_ % BITS
        if bits[at >> 3] >> (at & 7) & 1:
            yield _key(kind, p, value[:p]), value[p : LENGTHS[k + 1] + 1]


def whole_keys(kind: str, value: str, wanted: Filter) -> Iterator[tuple[int, str]]:
    """The key of :func:`whole_key` of a value that stands in the corpus, if the filter lets it pass."""
    at = crc32(value.encode("utf-8", "surrogatepass"), crc32(("=" + kind).encode())) % BITS
    if wanted.bits[at >> 3] >> (at & 7) & 1:
        yield whole_key(kind, value)


def key_rows(rows: Iterable[tuple[int, str]]) -> pa.RecordBatch:
    """Distinct (key, stretch) rows of a batch."""
    cols = list(zip(*rows, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["key", "stretch"])


STANDING = "key bigint, stretch string"


def answered(asked: DataFrame, standing: DataFrame, says: dict[str, Column]) -> DataFrame:
    """(key, rest, kind) distinct rows of ``asked`` with the columns of ``says``: whether any stretch of the key says so.

    ``says`` are conditions over kind, rest and stretch.
    """
    one = cut(asked.select("key", "rest", "kind").distinct())
    there = cut(standing.distinct())
    met = salted_join(one, there, "key")
    return met.groupBy("key", "rest", "kind").agg(*(F.max(c).alias(k) for k, c in says.items()))


def goes_on() -> Column:
    """Does the stretch go on after the rest?"""
    return F.col("stretch").startswith(F.col("rest")) & (F.length("stretch") > F.length("rest"))


def extensions(values: DataFrame) -> DataFrame:
    """(value) with repeats -> (value, extended) of every distinct value: is it a strict prefix of another?"""
    one = cut(values.filter("value is not null and value <> ''").select("value").distinct())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [prefix_key("v", v) for v in b.column(0).to_pylist()]
            cols = list(zip(*keys, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=["value", "key", "rest", "place"])

    asked = cut(one.mapInArrow(ask, "value string, key bigint, rest string, place int").withColumn("kind", F.lit("v")))
    wanted = Filter.of(asked)

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield key_rows({x for v in b.column(0).to_pylist() for x in standing_keys("v", v, wanted)})

    facts = answered(asked, one.mapInArrow(stand, STANDING), {"extended": goes_on()})
    return asked.join(facts, ["key", "rest", "kind"]).select("value", "extended")
