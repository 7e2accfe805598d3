from refloom.llm import survivors as S

_RECORDS = "rec_id bigint, paper_id string, title string, abstract string, citation_count int, publication_date string, doi string, provider string, retrieved_at timestamp_ntz, value string, extra int"


def _best(spark, rows, trust=(("a", 1), ("b", 2))):
    cols = ("rec_id", "paper_id", "title", "abstract", "citation_count", "publication_date", "doi", "provider", "retrieved_at")
    data = [tuple(r.get(c) for c in cols) + ("x", 1) for r in rows]
    r = S.with_clean_columns(spark.createDataFrame(data, _RECORDS))
    t = spark.createDataFrame(list(trust), "provider string, trust_rank int")
    return {(x.paper_id, x.field): (x.holder, x.value) for x in S.survivors(r, t, S.record_fields(all_fields=False)).collect()}


def _at(spark, day):
    import datetime

    return datetime.datetime(2024, 1, day)


def test_fields_are_chosen_one_by_one(spark):
    got = _best(
        spark,
        [
            {"rec_id": 1, "paper_id": "p", "abstract": "A long story of", "citation_count": 5, "publication_date": "2020", "doi": "10.1234/A", "provider": "b", "retrieved_at": _at(spark, 3)},
            {"rec_id": 2, "paper_id": "p", "abstract": "<p>Abstract: A long story of words</p>", "citation_count": -1, "publication_date": "2020/3", "doi": "https://doi.org/10.1234/b", "provider": "a", "retrieved_at": _at(spark, 1)},
            {"rec_id": 3, "paper_id": "p", "abstract": "N/A", "citation_count": 7, "publication_date": "2020-02-31", "doi": "junk", "provider": "z", "retrieved_at": _at(spark, 9)},
        ],
    )
    assert got == {("p", "abstract"): (2, "A long story of words"), ("p", "count"): (3, "7"), ("p", "date"): (2, "2020-03"), ("p", "doi"): (2, "10.1234/b")}


def test_ties_go_to_the_smaller_record_and_repeats_change_nothing(spark):
    row = {"paper_id": "p", "doi": "10.1234/a", "provider": "a", "retrieved_at": _at(spark, 1)}
    other = row | {"doi": "10.1234/b"}
    assert _best(spark, [row | {"rec_id": 4}, other | {"rec_id": 2}, other | {"rec_id": 3}, row | {"rec_id": 1}])[("p", "doi")] == (1, "10.1234/a")


def test_null_group_empty_table_and_unknown_provider(spark):
    assert _best(spark, []) == {}
    assert _best(spark, [{"rec_id": 1, "doi": "10.1234/a", "provider": "a"}]) == {}
    got = _best(spark, [{"rec_id": 1, "paper_id": "p", "doi": "10.1234/a", "provider": None}, {"rec_id": 2, "paper_id": "p", "doi": "10.1234/b", "provider": "b"}])
    assert got[("p", "doi")] == (2, "10.1234/b")


def test_text_under_three_titles_is_a_notice_but_not_under_three_ids(spark):
    rows = [{"rec_id": i, "paper_id": f"p{i}", "title": t, "abstract": a, "provider": "a"} for i, (t, a) in enumerate([("One", "Pay here to read on"), ("Two", "Pay here to read on"), ("Three", "Pay here to read on"), ("Four", "A true one"), ("<i>Four</i>", "A true one"), ("FOUR.", "A true one")])]
    assert {k[0] for k in _best(spark, rows) if k[1] == "abstract"} == {"p3", "p4", "p5"}


def test_group_of_very_many_records_gives_one_row_per_field(spark):
    rows = [{"rec_id": i, "paper_id": "p", "citation_count": i % 7, "provider": "a", "retrieved_at": _at(spark, 1 + i % 28)} for i in range(400)]
    assert set(_best(spark, rows)) == {("p", "count")}
