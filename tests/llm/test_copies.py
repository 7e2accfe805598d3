import random
from collections import Counter

import pytest

from refloom.llm import radix
from refloom.llm.canonical import canonical_bytes, squeeze
from refloom.llm.q_copies import canonical_keys


def _copies(spark, keys, **limits):
    df = spark.createDataFrame([(i, k if k is None else k.encode(), "x") for i, k in enumerate(keys)], "id bigint, key binary, bucket string")
    return {r.id: (r.n_copies, r.first_id) for r in radix.copies(df, **limits).collect()}


def _brute(keys):
    n = Counter(k for k in keys if k is not None)
    return {i: (n[k], keys.index(k)) for i, k in enumerate(keys) if k is not None}


@pytest.mark.parametrize("capacity", [2, 3, 20_000])
def test_counts_equal_brute_force_at_every_capacity(spark, capacity):
    rng = random.Random(4)
    keys = ["start" * 12 + "".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(150)] + ["hot"] * 60 + ["", "", None, "z" * 5000]
    assert _copies(spark, keys, capacity=capacity) == _brute(keys)


def test_splitting_goes_several_levels_deep_and_skips_shared_beginnings(spark):
    keys = [f"{'same beginning ' * 5}{a}xx{b}yy{c}" for a in "ab" for b in "ab" for c in "abcdef"]
    rows = spark.createDataFrame([(i, k.encode()) for i, k in enumerate(keys)], "id bigint, key binary")
    placed, levels = radix.bucketed(rows, capacity=2)
    assert levels == 3 and max(r["count"] for r in placed.groupBy("bucket").count().collect()) <= 2


def test_many_oversized_buckets_take_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(radix, "BROADCAST_ROWS", 0)
    keys = ["hot"] * 9 + [f"k{i % 5}{i}" for i in range(30)]
    assert _copies(spark, keys, capacity=2) == _brute(keys)


def test_plans_are_cut_after_some_levels(spark, monkeypatch):
    monkeypatch.setattr(radix, "LEVELS_A_CUT", 1)
    keys = ["ab", "abc", "abcd", "abcde", "abcdef", "b"] * 2
    assert _copies(spark, keys, capacity=1, step=1) == _brute(keys)


def test_empty_table_gives_nothing(spark):
    assert _copies(spark, []) == {} and _copies(spark, [None]) == {}


def test_trie_counts_keys_that_begin_one_another():
    t = radix.Trie()
    for k, i in ((b"abc", 5), (b"ab", 4), (b"abd", 3), (b"abc", 2), (b"", 1)):
        cell = t.add(k, 1, i)
    assert t.add(b"abc", 0, 9) == [2, 2] and t.add(b"ab", 0, 9) == [1, 4] and cell == [1, 1]


def test_formatting_and_order_of_fields_mean_nothing_but_words_do():
    a = canonical_bytes("Ann Lee. 2001. On Big Words. J. Words. 3(1). 2-23.", "On Big Words", ["Ann Lee"])
    assert a == canonical_bytes("J Words | 3/1 | ANN LEE | (2001) | “On  big words” | 2--23", "on big WORDS", ["Ann Lee"])
    assert a != canonical_bytes("Ann Lee. 2001. On Words Big. J. Words. 3(1). 2-23.", "On Words Big", ["Ann Lee"])
    assert a != canonical_bytes("Ann Lee. 2001. On Big Words. J. Words. 3(2). 2-23.", "On Big Words", ["Ann Lee"])
    assert canonical_bytes(None, "x", []) is None and canonical_bytes("  ", "x", None) is None
    assert canonical_bytes("r", None, None) != canonical_bytes("r", "", None)


@pytest.mark.parametrize("pages", ["2 - 23", "100 - 390"])
def test_page_range_between_dashes_may_span_any_number_of_pages(pages):
    first, last = pages.split(" - ")
    a = canonical_bytes(f"Ann Lee; On Words; J. Words; 11; {first}--{last}; 2006.", "On Words", ["Ann Lee"])
    assert a == canonical_bytes(f"J Words - 11 - {pages} - (2006) - Ann Lee - On words.", "On Words", ["Ann Lee"])


def test_plain_and_accented_text_are_squeezed_alike():
    assert squeeze("vol. 3 (12), p-4") == "vol3-12p4" and squeeze("é 3 ½") == "é3½"


def test_planted_copies_are_found(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    rows, truth = [], {}
    for g in range(60):
        title, name, year, vol = " ".join(rng.sample(words, 5)), f"{rng.choice(words).title()} {rng.choice(words).title()}", rng.randint(1950, 2020), rng.randint(1, 90)
        for _ in range(3):
            fields = [name, str(year), title, "Journal of Things", str(vol)]
            rng.shuffle(fields)
            t = rng.choice([title, title.upper(), title.title() + "."])
            raw = rng.choice([" | ", "; "]).join(f.upper() if rng.random() < 0.3 else f for f in fields)
            truth.setdefault(g, []).append(len(rows))
            rows.append((len(rows), raw, t, [name], None))
    df = spark.createDataFrame(rows, "entry_id bigint, raw string, title string, authors array<string>, extra string")
    got = {r.id: r.first_id for r in radix.copies(canonical_keys(df), capacity=10).collect()}
    right = sum(got[i] == ids[0] for ids in truth.values() for i in ids)
    assert right >= 0.9 * len(rows)
