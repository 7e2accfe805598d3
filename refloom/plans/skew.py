"""Joins that hold when one key carries a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key with more rows than this on one side is hot.
HOT_ROWS = 200_000
#: At most so many keys are spread. They are the most frequent ones, so a key left out holds less than one row in ``MAX_HOT_KEYS``.
MAX_HOT_KEYS = 100_000
SALTS = 32


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys of ``df`` with more than ``hot_rows`` rows, the most frequent ``MAX_HOT_KEYS`` of them (map-side combined count)."""
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    return n.orderBy(F.col("_n").desc(), key).limit(MAX_HOT_KEYS).select(key)


def _known(df: DataFrame, key: str, hot_rows: int) -> list:
    return [r[0] for r in hot_keys(df, key, hot_rows).collect()]


def _spread(df: DataFrame, salts: Column) -> Column:
    """Number of a row's share; by its content, so a task that runs again puts it in the same place."""
    return F.pmod(F.xxhash64(*df.columns), salts).cast("int")


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot_rows: int = HOT_ROWS, hot: list | None = None) -> DataFrame:
    """Join a large, possibly skewed ``left`` with ``right``, which is unique on ``key``.

    Hot keys are counted on ``left`` (or given as ``hot``, when one table is joined again and again).
    Their left rows are dealt out over ``SALTS`` shares and their right rows, one each, are copied to
    every share. Without hot keys it is a plain join. ``left`` is read once to count and once to join:
    cut it before if it is dear.
    """
    hot = _known(left, key, hot_rows) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    marks = F.broadcast(left.sparkSession.createDataFrame([(k, True) for k in hot], f"{key} {dict(left.dtypes)[key]}, _hot boolean"))  # at most MAX_HOT_KEYS
    salted = left.join(marks, key, "left").withColumn("_salt", F.when(F.col("_hot"), _spread(left, F.lit(SALTS))).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(marks, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(copied, [key, "_salt"], how).drop("_salt")


def salted_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS, salts: int = SALTS, hot_sides: tuple[bool, bool] = (True, True), hint: str | None = None) -> DataFrame:
    """Inner join of two sides that may both repeat ``key``; keys that are hot on either side are spread.

    A key hot on the left has its left rows dealt out and its right rows copied, one hot on the right
    the other way round, one hot on both sides goes to a grid. Nothing is dropped, every pair meets
    once, and other keys pay nothing. ``hot_sides``: false for a side known to be too small for a hot key.
    ``hint``: how the sides are joined; "merge" keeps either of them off the driver whatever its size is taken for.
    """
    hinted = lambda df: df.hint(hint) if hint else df
    by_left, by_right = (_known(df, key, hot_rows) if may else [] for df, may in zip((left, right), hot_sides, strict=True))
    if not by_left and not by_right:
        return left.join(hinted(right), key)
    kind = dict(left.dtypes)[key]
    sides = {k: (salts if k in set(by_left) else 1) for k in {*by_left, *by_right}}
    rows = [(k, n, salts if k in set(by_right) else 1) for k, n in sides.items()]
    marks = F.broadcast(left.sparkSession.createDataFrame(rows, f"{key} {kind}, _l int, _r int"))  # at most twice MAX_HOT_KEYS
    one = lambda c: F.coalesce(c, F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(F.col(c)) - 1))
    a = left.join(marks, key, "left").withColumn("_i", _spread(left, one(F.col("_l")))).withColumn("_j", every("_r")).drop("_l", "_r")
    b = right.join(marks, key, "left").withColumn("_j", _spread(right, one(F.col("_r")))).withColumn("_i", every("_l")).drop("_l", "_r")
    return a.join(hinted(b), [key, "_i", "_j"]).drop("_i", "_j")
