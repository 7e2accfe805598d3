import datetime
import random

from pyspark.sql import functions as F

from refloom.operators import integrity as I
from refloom.operators.integrity import State, advance, clean_key, parent_events, snapshot, standing_events

_T0 = datetime.datetime(2024, 1, 1)


def _day(n):
    return None if n is None else _T0 + datetime.timedelta(days=n)


def _refs(spark, rows):
    return spark.createDataFrame([(k, i, key, _day(d)) for k, i, key, d in rows], I.REFS)


def _events(spark, parents):
    df = spark.createDataFrame([(k, _day(a), _day(r)) for k, a, r in parents], "k string, a timestamp_ntz, r timestamp_ntz")
    return parent_events(df, F.col("k"), F.col("a"), F.col("r"))


def _brute(refs, parents, standing=()):
    out = set()
    for kind, i, key, d in refs:
        if key is None:
            continue
        mine = [(a, r) for k, a, r in parents if k == key and a is not None and (r is None or r > a)]
        there = key in standing or (bool(mine) if d is None else any(a <= d and (r is None or r > d) for a, r in mine))
        if not there:
            out.add((kind, i))
    return out


def _world(seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(12)] + ["hot"]
    parents = [(rng.choice(keys), rng.choice([None, *range(0, 120, 3)]), rng.choice([None, None, *range(0, 150, 3)])) for _ in range(40)]
    refs = [(rng.choice("xy"), i, rng.choice([*keys, *["hot"] * 6, None, ""]), rng.choice([None, *range(0, 130)])) for i in range(200)]
    return rng, refs, parents


def _found(state):
    return {(r.kind, r.row_id) for r in state.orphans().collect()}


def test_one_step_equals_brute_force_with_slices(spark):
    _, refs, parents = _world(1)
    for slices in (I.SLICE_ROWS, 2):
        state, changes = advance(State.empty(spark), _refs(spark, refs), _events(spark, parents).unionByName(standing_events(spark.createDataFrame([("k3",)], "key string"))), slice_rows=slices)
        assert _found(state) == _brute(refs, parents, {"k3"}) == {(r.kind, r.row_id) for r in changes.collect()}


def test_steps_of_any_order_end_like_one(spark):
    rng, refs, parents = _world(2)
    rng.shuffle(refs)
    rng.shuffle(parents)
    state, flips = State.empty(spark), set()
    for k in range(3):  # parents arrive in any order, late ones and removals too
        state, changes = advance(state, _refs(spark, refs[k::3]), _events(spark, parents[k::3]))
        flips |= {r.change for r in changes.collect()}
    assert _found(state) == _brute(refs, parents) and "resolved" in flips


def test_late_parents_resolve_and_departures_reopen(spark):
    none = _events(spark, [])
    state, c = advance(State.empty(spark), _refs(spark, [("x", 1, "a", 10), ("x", 2, "b", 10)]), none)
    assert {r.row_id: r.change for r in c.collect()} == {1: "orphan", 2: "orphan"}
    state, c = advance(state, _refs(spark, []), _events(spark, [("a", 5, None)]))
    assert {r.row_id: r.change for r in c.collect()} == {1: "resolved"}
    gone = spark.createDataFrame([("a", _day(8), -1)], I.EVENTS)
    state, c = advance(state, _refs(spark, [("x", 3, "a", 7)]), gone)
    assert {r.row_id: r.change for r in c.collect()} == {1: "reopened"} and _found(state) == {("x", 1), ("x", 2)}


def test_state_is_written_and_read(spark, tmp_path):
    _, refs, parents = _world(3)
    state, _ = advance(State.empty(spark), _refs(spark, refs[:100]), _events(spark, parents[:20]))
    state.save(str(tmp_path / "v1"))
    state, _ = advance(State.load(spark, str(tmp_path / "v1")), _refs(spark, refs[100:]), _events(spark, parents[20:]))
    assert _found(state) == _brute(refs, parents)


def test_snapshot_has_every_period(spark):
    refs = [("x", 1, "a", 0), ("x", 2, "a", 100), ("y", 3, "b", 40)]
    state, _ = advance(State.empty(spark), _refs(spark, refs), _events(spark, [("a", 50, 80)]))
    got = {(r.kind, r.period.month): (r.n_refs, r.n_orphans, r.n_waiting) for r in snapshot(state).collect()}
    assert got == {("x", 1): (1, 1, 1), ("x", 2): (0, 0, 0), ("x", 3): (0, 0, 1), ("x", 4): (1, 1, 2), ("y", 2): (1, 1, 1), ("y", 3): (0, 0, 1), ("y", 4): (0, 0, 1)}


def test_times_that_meet_and_parents_that_never_were(spark):
    parents = [("a", 5, 9), ("b", None, 3), ("c", 4, 4)]
    refs = [("x", 1, "a", 5), ("x", 2, "a", 9), ("x", 3, "b", 9), ("x", 4, "c", 4), ("x", 5, "a", None), ("x", 6, "c", None)]
    state, _ = advance(State.empty(spark), _refs(spark, refs), _events(spark, parents))
    assert _found(state) == {("x", i) for i in (2, 3, 4, 6)}


def test_keys_in_one_notation(spark):
    df = spark.createDataFrame([(" # B1 ",), (" b1",), (None,)], "k string")
    assert [r[0] for r in df.select(clean_key(F.col("k"), strip_hash=True)).collect()] == ["b1", "b1", None]


def test_empty_tables(spark):
    state, changes = advance(State.empty(spark), _refs(spark, []), _events(spark, []))
    assert changes.count() == 0 and snapshot(state).count() == 0
    assert advance(state, _refs(spark, []), _events(spark, []))[1].count() == 0
