import itertools
import os

import pytest

from refloom.llm import bpe, mixing
from refloom.llm.flow import greatest_total, route
from refloom.llm.mixing import mixture, shares

needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="vocabulary file not on this machine")


def test_flow_routes_what_brute_force_says():
    cap = {frozenset("a"): 3, frozenset("b"): 2, frozenset("ab"): 2}
    repeats = {"a": 1, "b": 2}

    def possible(qa, qb):  # tokens of the shared pattern that a and b take
        return any(qa <= 3 + x and qb <= 4 + y for x, y in itertools.product(range(3), range(5)))

    for qa, qb in itertools.product(range(8), range(10)):
        assert (route(cap, {"a": qa, "b": qb}, repeats)[1] == qa + qb) == possible(qa, qb)
    assert greatest_total(cap, {"a": 0.5, "b": 0.5}, repeats) >= 10


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0) for i, (t, s) in enumerate(rows)], "doc_id bigint, text string, source string, h int")


def _targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@needs_vocabulary
def test_shares_are_met_and_repeats_are_capped(spark):
    rows = [(f"word number {i} of the small source", "a") for i in range(20)] + [(f"line {i} of a large source here", "b") for i in range(300)]
    uses, plan = mixture(_docs(spark, rows), _targets(spark, [("a", 0.3, 2), ("b", 0.7, 1)]), bpe.vocabulary(spark))
    got = {r.source: r for r in shares(uses, plan).collect()}
    assert got["a"].most_uses <= 2 and got["b"].most_uses <= 1
    assert abs(got["a"].share - 0.3) < 0.02 and abs(got["b"].share - 0.7) < 0.02


@needs_vocabulary
def test_ranges_do_not_change_the_mixture(spark, monkeypatch):
    rows = [(f"text {i}", "ab"[i % 2]) for i in range(60)]
    args = _docs(spark, rows), _targets(spark, [("a", 0.5, 1), ("b", 0.5, 3)]), bpe.vocabulary(spark)
    one = {tuple(r) for r in mixture(*args)[0].collect()}
    monkeypatch.setattr(mixing, "RANGES", 3)
    assert {tuple(r) for r in mixture(*args)[0].collect()} == one


@needs_vocabulary
def test_copies_nulls_and_sources_without_documents(spark):
    rows = [("same text", "a"), ("same text", "a"), ("same text", "b"), (None, "a"), ("", "b"), ("more words", None), ("other", "z")]
    targets = _targets(spark, [("a", 0.5, 1), ("b", 0.5, 1), ("none", None, 1), (None, 0.2, 1)])
    uses, _ = mixture(_docs(spark, rows), targets, bpe.vocabulary(spark))
    assert {r.doc_id for r in uses.collect()} <= {0, 2}
    empty, plan = mixture(_docs(spark, rows), _targets(spark, [("a", 0.5, 1), ("missing", 0.5, 1)]), bpe.vocabulary(spark))
    assert empty.count() == 0 and plan.count() == 2
    assert mixture(_docs(spark, rows), _targets(spark, [("a", 0.5, 1), ("missing", 0.5, 1)]), bpe.vocabulary(spark), total_tokens=4)[0].count() == 1
    assert mixture(_docs(spark, []), _targets(spark, []), bpe.vocabulary(spark))[0].count() == 0


@needs_vocabulary
def test_more_sources_than_a_number_has_bits(spark):
    rows = [(f"text of source {i}", f"s{i:03}") for i in range(70)]
    uses, _ = mixture(_docs(spark, rows), _targets(spark, [(f"s{i:03}", 1 / 70, 1) for i in range(70)]), bpe.vocabulary(spark))
    assert uses.select("source").distinct().count() == 70
