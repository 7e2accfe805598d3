from refloom.llm.truncation import judged


def _cut(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    return {r.id for r in judged(df).filter("is_cut").collect()}


def test_list_item_that_a_longer_copy_continues_was_cut(spark):
    whole = "The plan has two parts.\n- read the given tables\n- write the results to the folder\nThat is all."
    at = whole.index(" to the folder")
    assert _cut(spark, [whole, whole[:at]]) == {1}


def test_list_item_that_ends_at_its_line_was_not_cut(spark):
    whole = "The plan has two parts.\n- read the given tables\n- write the results\nThat is all."
    assert _cut(spark, [whole, whole[: whole.index("\nThat")], "Another.\n- a lonely item here"]) == set()


def test_prefixes_equal_brute_force(spark):
    import random

    from refloom.llm.prefixes import extensions

    rng = random.Random(8)
    values = ["".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(250)] + ["", None, "x" * 4000, "x" * 3999, "é", "éa"]
    got = {r.value: r.extended for r in extensions(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    known = {v for v in values if v}
    assert got == {v: any(o != v and o.startswith(v) for o in known) for v in known}
    assert extensions(spark.createDataFrame([], "value string")).count() == 0


def test_full_filter_changes_nothing(spark, monkeypatch):
    from refloom.llm import prefixes

    values = spark.createDataFrame([(f"value {i % 40} {'tail' * (i % 3)}",) for i in range(120)], "value string")
    want = {tuple(r) for r in prefixes.extensions(values).collect()}
    monkeypatch.setattr(prefixes, "BITS", 8)
    assert {tuple(r) for r in prefixes.extensions(values).collect()} == want


def test_evidence_is_named(spark):
    texts = ["The small graph explains the large method well. All is done.", "The small graph explains the lar", "Nothing like it explains the lar", "Quite another story without"]
    out = {r.id: r.evidence for r in judged(spark.createDataFrame(list(enumerate(texts * 1)), "id bigint, text string")).collect()}
    assert out[0] is None and out[1] == "unit"
    assert {r.id: r.is_cut for r in judged(spark.createDataFrame([(0, "A title of its own"), (1, None), (2, " "), (3, "Done.")], "id bigint, text string")).collect()} == {0: False, 1: False, 2: False, 3: False}


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "One thing was done. Another thing was only half", 0)] * 2 + [(1, "All done.", 0)], "id bigint, text string, kind int")
    assert sorted(r.is_cut for r in judged(df).collect()) == [False, True, True]
    assert judged(spark.createDataFrame([], "id bigint, text string")).count() == 0


def test_planted_cuts_are_found(spark):
    import random

    rng = random.Random(11)
    words = "graph method token model corpus filter index signal word table paper author".split()
    sentence = lambda: f"The {rng.choice(words)} {rng.choice(['explains', 'moves', 'improves'])} the {rng.choice(words)} of every {rng.choice(words)} in the {rng.choice(words)}."
    texts = [" ".join(sentence() for _ in range(6)) for _ in range(200)]
    cut = {i for i in range(0, 200, 4)}
    rows = [(i, t[: rng.randint(len(t) // 2, len(t) - 8)] if i in cut else t) for i, t in enumerate(texts)]
    true = {i for i, t in rows if i in cut and not t.rstrip().endswith(".")}
    got = {r.id for r in judged(spark.createDataFrame(rows, "id bigint, text string")).filter("is_cut").collect()}
    assert len(true & got) >= 0.9 * len(true) and len(true & got) >= 0.9 * len(got)
