import random

from pyspark.sql import functions as F

from refloom.plans.numbering import number_rows
from refloom.plans.skew import hot_keys, lookup_join, salted_join


def _sides(spark):
    rng = random.Random(1)
    left = [(rng.choice(["hot"] * 5 + ["a", "b", "c", None]), i, 0) for i in range(120)]
    right = [(rng.choice(["hot"] * 3 + ["a", "b", "z"]), i) for i in range(30)]
    return left, right, spark.createDataFrame(left, "key string, x int, y int"), spark.createDataFrame(right, "key string, z int")


def test_salted_join_equals_a_plain_one(spark):
    left, right, a, b = _sides(spark)
    want = sorted((k, x, z) for k, x, _ in left for k2, z in right if k == k2)
    for hot in (2, 15, 1000):
        assert sorted((r.key, r.x, r.z) for r in salted_join(a, b, "key", hot_rows=hot, salts=4).collect()) == want


def test_lookup_join_keeps_rows_of_hot_keys(spark):
    left, _, a, _ = _sides(spark)
    facts = spark.createDataFrame([("hot", 1), ("a", 2)], "key string, f int")
    for hot in (2, 1000):
        got = sorted((r.key or "", r.x, r.f or 0) for r in lookup_join(a, facts, "key", hot_rows=hot).collect())
        assert got == sorted((k or "", x, {"hot": 1, "a": 2}.get(k, 0)) for k, x, _ in left)
        assert lookup_join(a, facts, "key", "inner", hot_rows=hot).count() == sum(k in ("hot", "a") for k, *_ in left)
    assert lookup_join(a, facts, "key", hot=["hot"]).count() == len(left)


def test_hot_keys_are_the_most_frequent(spark):
    _, _, a, _ = _sides(spark)
    assert [r[0] for r in hot_keys(a, "key", 20).collect()] == ["hot"]


def test_rows_are_numbered_in_order_whatever_they_begin_with(spark):
    keys = [f"10.1101/{i:05}" for i in random.Random(2).sample(range(10_000), 300)]
    df = spark.createDataFrame([(k, 1) for k in keys], "k string, extra int").repartition(5)
    assert {r.k: r.n for r in number_rows(df, "k", "n").collect()} == {k: i for i, k in enumerate(sorted(keys), 1)}
    assert number_rows(df.filter("k is null"), "k", "n").count() == 0


def test_salts_do_not_depend_on_the_run(spark):
    _, _, a, b = _sides(spark)
    once = salted_join(a, b, "key", hot_rows=2).select(F.sum(F.xxhash64("key", "x", "z") % 1000)).first()
    assert once == salted_join(a.repartition(7), b, "key", hot_rows=2).select(F.sum(F.xxhash64("key", "x", "z") % 1000)).first()
