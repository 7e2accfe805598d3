"""Referential integrity over time: references to records that are missing, gone or not there yet.

The state is kept by key and carried from run to run: the parents' arrivals and departures (the parent
index), and every reference with the number of parents that stood when it was seen. A step takes new
references and new parent events only. New references probe the index; parents that arrive, be it late,
raise the number of the references they stood for and so resolve waiting orphans; departures lower it and
reopen them. Keys without a new event are passed on untouched. Steps of any size and order end in the
same state, and snapshots of it count orphans per kind and period.

A probe sums the events of a key up to the time of the reference. Periods cut that ledger: the net change
per key and period is combined map-side, a running sum over those few rows gives the state that each
period opens with, and within a period a window does the rest. A period in which one key has very many
references is dealt out over slices, each with a copy of the period's few parent events.

Defined cases
- null key: no reference, so no orphan. Empty key: a key like any other.
- parent without added_at: never there. Parent removed at or before its arrival: never there.
- a parent added at the very time of the reference is there; one removed at that time is gone.
- reference without seen_at: cannot be placed in time, it is an orphan only if no parent ever stood.
- repeated parents count once each; repeated references are each reported.
- empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from refloom.plans.lineage import cut
from refloom.plans.skew import MAX_HOT_KEYS

#: References of one key in one period beyond this many are spread over several tasks.
SLICE_ROWS = 50_000
EVENTS = "key string, ts timestamp_ntz, delta bigint"
REFS = "kind string, row_id bigint, key string, seen_at timestamp_ntz"
#: When parents that are there at all times arrive.
ALWAYS = "0001-01-01 00:00:00"


@dataclass(frozen=True)
class State:
    """``events``: key, ts, delta. ``refs``: kind, row_id, key, seen_at, there (parents that stood for it)."""

    events: DataFrame
    refs: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(spark.createDataFrame([], EVENTS), spark.createDataFrame([], REFS + ", there bigint"))

    def save(self, folder: str) -> None:
        """Write the state; a new folder for every version, so readers of the last one are not disturbed."""
        self.events.write.mode("overwrite").parquet(f"{folder}/events")
        self.refs.write.mode("overwrite").parquet(f"{folder}/refs")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> State:
        return State(spark.read.schema(EVENTS).parquet(f"{folder}/events"), spark.read.schema(REFS + ", there bigint").parquet(f"{folder}/refs"))

    def orphans(self) -> DataFrame:
        return self.refs.filter("there <= 0").drop("there")


def clean_key(c: Column, strip_hash: bool = False) -> Column:
    """Lower case without outer blanks; ``strip_hash`` also drops one leading ``#``."""
    c = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(c, r"(?U)^#\s*", "") if strip_hash else c


def parent_events(parents: DataFrame, key: Column, added: Column, removed: Column) -> DataFrame:
    """Arrivals (+1) and departures (-1) of parent rows as (key, ts, delta), one row per key and instant."""
    p = parents.select(key.alias("key"), added.alias("a"), removed.alias("r"))
    p = p.filter(F.col("key").isNotNull() & F.col("a").isNotNull() & (F.col("r").isNull() | (F.col("r") > F.col("a"))))
    moves = F.array(
        F.struct(F.col("a").alias("ts"), F.lit(1).cast("bigint").alias("delta")),
        F.struct(F.col("r").alias("ts"), F.lit(-1).cast("bigint").alias("delta")),
    )
    return _net(p.select("key", F.explode(moves).alias("e")).select("key", "e.ts", "e.delta").filter(F.col("ts").isNotNull()))


def standing_events(keys: DataFrame) -> DataFrame:
    """Arrivals of parents (key) that are there at all times."""
    return keys.filter("key is not null").select("key", F.lit(ALWAYS).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("delta"))


def _net(events: DataFrame) -> DataFrame:
    return events.groupBy("key", "ts").agg(F.sum("delta").alias("delta")).filter(F.col("delta") != 0)


def _period(ts: str, period: str) -> Column:
    return F.date_trunc(period, F.col(ts)).cast("date")


def period_states(refs: DataFrame, events: DataFrame, period: str) -> DataFrame:
    """State per key and period with any event: opening (parents there), net, n_refs."""
    zero = F.lit(0).cast("bigint")
    parts = [
        events.select("key", _period("ts", period).alias("period"), "delta", zero.alias("n")),
        refs.filter("seen_at is not null").select("key", _period("seen_at", period).alias("period"), zero.alias("delta"), F.lit(1).cast("bigint").alias("n")),
    ]
    per = reduce(DataFrame.unionByName, parts).groupBy("key", "period").agg(F.sum("delta").alias("net"), F.sum("n").alias("n_refs"))
    w = W.partitionBy("key").orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    return per.select("*", F.coalesce(F.sum("net").over(w), F.lit(0)).alias("opening"))


def probe(refs: DataFrame, events: DataFrame, period: str = "month", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``refs`` with ``there``: sum of the events of their key up to the time they were seen."""
    states = period_states(refs, events, period)
    # The largest pairs of key and period; one that is left out holds less than one row in MAX_HOT_KEYS.
    wide = states.filter(F.col("n_refs") > slice_rows).orderBy(F.col("n_refs").desc(), "key", "period").limit(MAX_HOT_KEYS)
    wide = F.broadcast(wide.select("key", "period", F.ceil(F.col("n_refs") / slice_rows).cast("int").alias("slices")))
    none = F.lit(None).cast("string")
    opening = states.filter("n_refs > 0").select("key", "period", F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("opening").alias("delta"), none.alias("kind"), F.lit(None).cast("bigint").alias("row_id"))
    moves = events.select("key", _period("ts", period).alias("period"), "ts", "delta", none.alias("kind"), F.lit(None).cast("bigint").alias("row_id"))
    shared = opening.unionByName(moves).join(wide, ["key", "period"], "left")
    shared = shared.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    timed = refs.filter("seen_at is not null").select("key", _period("seen_at", period).alias("period"), F.col("seen_at").alias("ts"), F.lit(0).cast("bigint").alias("delta"), "kind", "row_id")
    timed = timed.join(wide, ["key", "period"], "left").withColumn("slice", F.pmod(F.xxhash64("row_id"), F.coalesce("slices", F.lit(1))).cast("int"))
    ledger = shared.drop("slices").unionByName(timed.drop("slices"))
    # nulls first: the opening state, then parents before references of the same instant
    w = W.partitionBy("key", "period", "slice").orderBy(F.col("ts").asc_nulls_first(), F.col("kind").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = ledger.withColumn("there", F.sum("delta").over(w)).filter("kind is not null")
    out = found.select("kind", "row_id", "key", F.col("ts").alias("seen_at"), "there")
    ever = events.filter("delta > 0").groupBy("key").agg(F.sum("delta").alias("there"))
    untimed = refs.filter("seen_at is null").join(ever, "key", "left")
    return out.unionByName(untimed.select("kind", "row_id", "key", "seen_at", F.coalesce("there", F.lit(0)).alias("there")))


def advance(state: State, refs: DataFrame, events: DataFrame, period: str = "month", slice_rows: int = SLICE_ROWS) -> tuple[State, DataFrame]:
    """The state after new references (kind, row_id, key, seen_at) and parent events (key, ts, delta), and what changed.

    Changes: (kind, row_id, key, seen_at, change) with ``orphan`` for a new reference without parent,
    ``resolved`` and ``reopened`` for older ones.
    """
    refs = refs.select("kind", "row_id", "key", "seen_at").filter(F.col("key").isNotNull())
    events = cut(_net(events.select("key", "ts", "delta")))
    first = state.refs.isEmpty() and state.events.isEmpty()
    index = events if first else cut(_net(state.events.unionByName(events)))
    asked = index if first else index.join(refs.select("key").distinct(), "key", "left_semi")
    fresh = probe(refs, asked, period, slice_rows)
    if first:
        after = cut(fresh)
        return State(index, after), after.filter("there <= 0").drop("there").withColumn("change", F.lit("orphan"))
    touched = events.select("key", F.lit(True).alias("touched")).distinct()
    old = cut(state.refs.join(touched, "key", "left"))
    moved = old.filter("touched").drop("touched")
    gain = probe(moved.drop("there"), events, period, slice_rows).select("kind", "row_id", F.col("there").alias("gain"))
    # A reference that repeats under one id has the same key and time each time, hence the same gain.
    moved = cut(moved.join(gain.distinct(), ["kind", "row_id"]).withColumn("was", F.col("there")).withColumn("there", F.col("was") + F.col("gain")))
    fresh = cut(fresh)
    flips = F.when((F.col("was") <= 0) & (F.col("there") > 0), "resolved").when((F.col("was") > 0) & (F.col("there") <= 0), "reopened")
    cols = ["kind", "row_id", "key", "seen_at"]
    changes = moved.withColumn("change", flips).filter("change is not null").select(*cols, "change")
    changes = changes.unionByName(fresh.filter("there <= 0").select(*cols, F.lit("orphan").alias("change")))
    after = old.filter("touched is null").drop("touched").unionByName(moved.select(*cols, "there")).unionByName(fresh)
    return State(index, after), changes


def snapshot(state: State, period: str = "month") -> DataFrame:
    """(kind, period, n_refs, n_orphans, n_waiting): references seen in each period, orphans among them, orphans waiting at its end.

    A reference waits while no parent of its key is there. Every kind has a row for every period from its
    first reference to the last period of any kind.
    """
    refs = state.refs.filter("seen_at is not null")
    # One row per key and period: all that follows is free of hot keys.
    per_kind = cut(refs.groupBy("kind", "key", _period("seen_at", period).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("there") <= 0).alias("lost")))
    seen = per_kind.groupBy("kind", "period").agg(F.sum("n").alias("n_refs"), F.sum("lost").alias("n_orphans"))
    # Change of the waiting count of each key where anything happens, then a running sum per kind.
    moves = state.events.select("key", _period("ts", period).alias("period"), "delta").groupBy("key", "period").agg(F.sum("delta").alias("net"))
    kinds = per_kind.select("kind", "key").distinct()
    grid = moves.join(kinds, "key").select("kind", "key", "period", "net", F.lit(0).cast("bigint").alias("n"))
    grid = grid.unionByName(per_kind.select("kind", "key", "period", F.lit(0).cast("bigint").alias("net"), "n"))
    grid = grid.groupBy("kind", "key", "period").agg(F.sum("net").alias("net"), F.sum("n").alias("n"))
    w = W.partitionBy("kind", "key").orderBy("period")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    grid = grid.withColumns({"there": F.sum("net").over(upto), "sofar": F.sum("n").over(upto)})
    grid = grid.withColumn("waiting", F.when(F.col("there") <= 0, F.col("sofar")).otherwise(0))
    grid = grid.withColumn("change", F.col("waiting") - F.coalesce(F.lag("waiting").over(w), F.lit(0)))
    change = grid.groupBy("kind", "period").agg(F.sum("change").alias("change"))
    ends = seen.agg(F.max("period").alias("last"))  # one row
    span = seen.groupBy("kind").agg(F.min("period").alias("first")).join(F.broadcast(ends))
    every = span.select("kind", F.explode(F.sequence("first", "last", F.expr(f"interval 1 {period}"))).alias("period"))  # a row per period
    run = W.partitionBy("kind").orderBy("period").rowsBetween(W.unboundedPreceding, 0)  # a row per period
    waiting = every.join(change, ["kind", "period"], "full").select("kind", "period", F.sum(F.coalesce("change", F.lit(0))).over(run).alias("n_waiting"))
    out = every.join(seen, ["kind", "period"], "left").join(waiting, ["kind", "period"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("kind", "period", zero("n_refs"), zero("n_orphans"), "n_waiting")
