"""Token-order-free title scores, and a join that applies them to a bounded side in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from refloom.plans.lineage import cut

#: Titles of the smaller side that one pass holds; a larger side takes several passes. Titles of it that its bits are chosen by.
BLOCK, SAMPLE = 100_000, 10_000
#: Titles of the two sides that are compared at once, titles that are laid out together, and pairs that go on to the longer tests together.
ROWS, TILE, LOT, PAIRS = 32, 4096, 32_768, 16_384
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Codes of the characters: all others share one, which makes titles no less alike; the last one fills up.
CODES = np.array([ALPHABET.find(chr(i)) % (len(ALPHABET) + 1) for i in range(128)], dtype=np.uint8)
OTHER, FILL, TIMES = len(ALPHABET), len(ALPHABET) + 1, 3
#: Bits for letters and for pairs of letters, of these the ones that rarer pairs share; sums of letter counts, and those of them that titles are laid out by.
LETTER_BITS, PAIR_BITS, SHARED_BITS, SUMS, AXES = 128, 1024, 64, 5, 3


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 less the share of insertions and deletions that turn a into b."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if not both:
        return ratio(left, right)
    if not left or not right:
        return 100.0
    # What two strings begin with is part of their longest common subsequence.
    n, one, two = len(both), len(both) + 1 + len(left), len(both) + 1 + len(right)
    return max(200.0 * (n + 1 + lcs(left, right)) / (one + two), 200.0 * n / (n + one), 200.0 * n / (n + two))


def title_score(a: str, b: str) -> float:
    return min(token_set(a, b), token_sort(a, b))


class Spec(NamedTuple):
    """What bits stand for: (letter, least count) each, the bit of each pair of letters; the sign of each letter in each sum."""

    steps: tuple[np.ndarray, np.ndarray]
    pairs: np.ndarray
    signs: np.ndarray


class Side(NamedTuple):
    """Titles with their words sorted: characters one after the other, where each begins, lengths, letter counts, bits of letters (a row a word) and of pairs, sums."""

    chars: np.ndarray
    start: np.ndarray
    length: np.ndarray
    counts: np.ndarray
    letters: np.ndarray
    pairs: np.ndarray
    sums: np.ndarray


def _chars(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all characters of the titles with their words sorted, the title of each, and the lengths."""
    texts = [" ".join(sorted(t.split())) for t in titles]
    length = np.array([len(t) for t in texts], dtype=np.int64)
    codes = CODES[np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 127)]
    return codes, np.repeat(np.arange(len(texts)), length), length


def _pairs(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Titles and pairs of neighbouring letters; a pair's second time in a title, and its third, count as other pairs."""
    same = np.flatnonzero(row[1:] == row[:-1])
    key = np.sort(row[same] * FILL**2 + codes[same].astype(np.int64) * FILL + codes[same + 1])
    at = np.arange(len(key))
    first = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1])[: len(key)], at, 0))
    return key // FILL**2, key % FILL**2 * TIMES + np.minimum(at - first, TIMES - 1)


def spec_of(titles: list[str]) -> Spec:
    """Bits that tell such titles apart best. Any choice is right: it decides only how many pairs of titles need the longer tests."""
    codes, row, length = _chars(titles)
    counts = np.bincount(row * FILL + codes, minlength=len(titles) * FILL).reshape(-1, FILL)
    share = np.stack([(counts >= t).mean(axis=0) for t in range(1, 33)], axis=1)
    letter, step = np.unravel_index(np.argsort(-(share * (1 - share)), axis=None, kind="stable")[:LETTER_BITS], share.shape)
    row, pair = _pairs(codes, row)
    kinds = FILL**2 * TIMES
    share = np.bincount(np.unique(row * kinds + pair) % kinds, minlength=kinds) / max(1, len(titles))
    bits = np.arange(kinds) % SHARED_BITS
    own = np.argsort(-(share * (1 - share)), kind="stable")[: PAIR_BITS - SHARED_BITS]
    bits[own] = SHARED_BITS + np.arange(len(own))
    # Each sum's signs let it vary most, apart from what the sums before it tell.
    cov, signs = np.cov(counts.T) if len(titles) > 1 else np.eye(FILL), []
    for _ in range(SUMS):
        c = np.ones(FILL)
        for _ in range(10):
            for k in range(FILL):
                c[k] = 1 if cov[k] @ c - cov[k, k] * c[k] >= 0 else -1
        signs.append(c)
        told = cov @ c
        cov = cov - np.outer(told, told) / max(c @ told, 1e-9)
    return Spec((letter, step + 1), bits, np.array(signs).T.astype(np.int64))


def side_of(titles: list[str], spec: Spec) -> Side:
    codes, row, length = _chars(titles)
    n, start = len(titles), np.cumsum(length) - length
    chars = np.append(codes, np.uint8(FILL))
    counts = np.bincount(row * FILL + codes, minlength=n * FILL).reshape(n, FILL)
    letters = np.ascontiguousarray(np.packbits(counts[:, spec.steps[0]] >= spec.steps[1], axis=1)).view(np.uint64)
    pairs = np.zeros((n, PAIR_BITS // 8), dtype=np.uint8)
    row, pair = _pairs(codes, row)
    np.bitwise_or.at(pairs, (row, spec.pairs[pair] // 8), (1 << (spec.pairs[pair] % 8)).astype(np.uint8))
    return Side(chars, start, length, np.minimum(counts, np.iinfo(np.int16).max).astype(np.int16), np.ascontiguousarray(letters.T), pairs.view(np.uint64), (counts @ spec.signs).T.astype(np.float32))


def boxes(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of ``x`` in lots of ``most`` at most, halved where they lie widest."""
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        k = int(np.argmax(x[rows].std(axis=0)))
        rows = rows[np.argsort(x[rows, k], kind="stable")]
        half = -(-len(rows) // 2 // most) * most  # whole lots on the first side
        todo += [rows[half:], rows[:half]]
    return out


def texts(x: Side, i: np.ndarray) -> np.ndarray:
    """Characters of titles i, a column a title, filled up to the longest."""
    step = np.arange(int(x.length[i].max()))[:, None]
    return x.chars.take(np.where(step < x.length[i], x.start[i] + step, len(x.chars) - 1))


def alike(x: Side, y: Side, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs whose words, sorted, are ``least`` or more alike: longest common subsequences of all pairs at once, bit-parallel over x.

    A pair is left where even a common rest of y would not do.
    """
    rows, own = np.unique(i, return_inverse=True)
    mine, text, joint = texts(x, rows), texts(y, j), x.length[i] + y.length[j]
    last, width = len(text), max(1, -(-len(mine) // 64))
    where = np.zeros((width, len(rows), FILL + 1), dtype=np.uint64)
    for k, chars in enumerate(mine):
        where[k // 64, np.arange(len(rows)), chars] |= np.uint64(1 << k % 64)
    where[:, :, FILL] = 0
    where, base = where.reshape(width, -1), own * (FILL + 1)
    row = np.full((width, len(i)), np.iinfo(np.uint64).max, dtype=np.uint64)
    for step in range(last + 1):
        if step in (last // 2, last * 5 // 8, last * 3 // 4, last):
            score = 200.0 * (width * 64 - np.bitwise_count(row).sum(axis=0, dtype=np.int64) + np.maximum(0, y.length[j] - step)) / np.maximum(1, joint)
            ok = np.flatnonzero(score >= least)
            i, j, base, joint, score, row = i[ok], j[ok], base[ok], joint[ok], score[ok], row[:, ok]
            text = text[:, ok] if step < last else text
        if step == last or not len(i):
            break
        at, carry = base + text[step], None
        for w in range(width):
            old = row[w]
            hit = old & where[w].take(at)
            new = old + hit
            over = new < old if w + 1 < width else None
            if carry is not None:
                new += carry
                if over is not None:
                    over |= new < carry
            carry = over
            row[w] = new | (old ^ hit)
    return i, j, score


def near(x: Side, y: Side, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of all titles of x and y whose words, sorted, are ``least`` or more alike.

    Titles that score s are at most (100-s)% of their joint length apart in insertions and deletions. Each of these
    changes one letter's count by one, and at most three counts of pairs of neighbours, so sums of letter counts, bits
    of counts and bits of pairs are never further apart than that.
    """
    room, kept, left = (100 - least) / 100, [], []

    def tested(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.floor(room * (x.length[i] + y.length[j]) + 1e-9)
        bits, low = np.bitwise_count(x.pairs.take(i, axis=0) ^ y.pairs.take(j, axis=0)).view(np.uint64), np.uint64(0x00FF00FF00FF00FF)
        # Eight counts a word, one for each 64 bits: added in lanes of 16 bits.
        bits = sum((bits[:, k] & low) + (bits[:, k] >> np.uint64(8) & low) for k in range(bits.shape[1])) * np.uint64(0x0001000100010001) >> np.uint64(48)
        ok = np.flatnonzero(bits <= 3 * apart)
        i, j, apart = i[ok], j[ok], apart[ok]
        ok = np.flatnonzero(np.abs(x.counts[i] - y.counts[j]).sum(axis=1) <= apart)
        return i[ok], j[ok]

    def joined(lots: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(v) for v in zip(*lots, strict=True))
        lots.clear()
        return i, j

    def results(most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if kept and sum(len(i) for i, _ in kept) > most:
            i, j = joined(kept)
            left.extend(tested(i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS))
        if left and sum(len(i) for i, _ in left) > most:
            i, j = joined(left)
            words = np.maximum(1, -(-np.minimum(x.length[i], y.length[j]) // 64))  # of the shorter title
            swap = y.length[j] < x.length[i]
            for w in np.unique(words):
                step = max(1, PAIRS // int(w))
                for back in (False, True):
                    at = np.flatnonzero((words == w) & (swap == back))
                    for k in range(0, len(at), step):
                        a, b = i[at[k : k + step]], j[at[k : k + step]]
                        if back:
                            b, a, score = alike(y, x, b, a, least)
                        else:
                            a, b, score = alike(x, y, a, b, least)
                        yield a, b, score

    xor, count, bits, ok = (np.empty(ROWS * TILE + 8, dtype=t) for t in (np.uint64, np.uint8, np.uint8, np.bool_))
    most = (room * y.length + 1e-3).astype(np.float32)
    share = np.floor(room * y.length)
    for rows in boxes(x.sums[:AXES].T, ROWS):
        length, letters = x.length[rows], x.letters.take(rows, axis=1)[:, :, None]
        # Titles that no sum puts too far from all of these.
        ok_y = np.ones(len(most), dtype=bool)
        for k in range(len(x.sums)):
            lo, hi = x.sums[k, rows].min(), x.sums[k, rows].max()
            ok_y &= np.abs(y.sums[k] - (lo + hi) / 2) - most <= np.float32((hi - lo) / 2 + room * length.max())
        those = np.flatnonzero(ok_y)
        words = y.letters.take(those, axis=1)
        for lo in range(0, len(those), TILE):
            hi = min(lo + TILE, len(those))
            n = len(rows) * (hi - lo)
            a, b, c, d = (v[:n].reshape(len(rows), hi - lo) for v in (xor, bits, count, ok))
            for w in range(len(words)):
                np.bitwise_xor(letters[w], words[w, lo:hi], out=a)
                np.bitwise_count(a, out=c if w else b)
                if w:
                    np.add(b, c, out=b)
            # One more than both shares, rounded down, is no less than their sum. The longest of y gives the limit, others count as so much further apart.
            shares = share[those[lo:hi]]
            longest = shares.max()
            np.add(b, np.minimum(127, longest - shares).astype(np.uint8), out=b)
            np.less_equal(b, np.minimum(255, np.floor(room * length) + 1 + longest).astype(np.uint8)[:, None], out=d)
            # Nearly all are no: found by eights first.
            ok[n : n + 8] = False
            eights = ok[: n + 7 & ~7].reshape(-1, 8)
            some = np.flatnonzero(eights.view(np.uint64)[:, 0] != 0)
            row, col = np.nonzero(eights[some])
            at = some[row] * 8 + col
            if len(at):
                kept.append((rows[at // (hi - lo)], those[lo + at % (hi - lo)]))
        yield from results(16 * PAIRS)
    yield from results(0)


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of distinct normalised titles scoring ``least`` or more; no pair is lost.

    ``left`` (a) stays distributed; ``right`` (b) is counted and passed over in blocks of ``BLOCK``
    titles, which are laid out once and sent to all workers.
    """
    spark = left.sparkSession
    passes = max(1, -(-right.count() // BLOCK))
    titles = right.select("b").filter("b <> ''").distinct().withColumn("block", F.pmod(F.xxhash64("b"), F.lit(passes)))
    mine = left.select("a").filter("a <> ''").distinct().repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if passes > 1:
        titles, mine = cut(titles), cut(mine)
    out = None
    for block in range(passes):
        b = sorted((r[0] for r in titles.filter(F.col("block") == block).select("b").collect()), key=lambda t: (len(t), t))  # at most about BLOCK titles
        if not b:
            continue
        spec = spec_of(b[:: max(1, len(b) // SAMPLE)])
        side = spark.sparkContext.broadcast((b, tuple(spec), tuple(side_of(b, spec))))  # tuples: workers need no copy of the package

        def score(batches: Iterator[pa.RecordBatch], side=side) -> Iterator[pa.RecordBatch]:
            b, spec, y = side.value
            spec, y = Spec(*spec), Side(*y)

            def lots() -> Iterator[list[str]]:
                lot: list[str] = []
                for batch in batches:
                    lot += batch.column(0).to_pylist()
                    if len(lot) >= LOT:
                        yield lot
                        lot = []
                if lot:
                    yield lot

            for a in lots():
                x = side_of(a, spec)
                for i, j, sorted_score in near(x, y, least):
                    rows: list[tuple[str, str, float]] = []
                    other = (x.counts[i, OTHER] > 0) & (y.counts[j, OTHER] > 0)
                    for p, q, s, again in zip(i.tolist(), j.tolist(), sorted_score.tolist(), other.tolist(), strict=True):
                        s = min(token_sort(a[p], b[q]) if again else s, token_set(a[p], b[q]))
                        if s >= least:
                            rows.append((a[p], b[q], s))
                    cols = list(zip(*rows, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["a", "b", "score"])

        part = mine.mapInArrow(score, "a string, b string, score double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "a string, b string, score double")
