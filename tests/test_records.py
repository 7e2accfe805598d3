import pytest
from pyspark.sql import functions as F

from refloom.functions import ids as I
from refloom.functions import texts as T
from refloom.functions import years as Y
from refloom.functions.fuzzy import fuzzy_pairs, ratio, title_score, token_set, token_sort
from refloom.functions.register import register
from refloom.operators import records as N
from refloom.operators import resolve as R
from refloom.operators.views import spread, uncollide


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "out"), [(" HTTPS://DOI.org/10.1/A ", "10.1/a"), ("http://dx.doi.org/10.1/a", "10.1/a"), ("10.1/A", "10.1/a"), ("", None), (" ", None), (None, None)])
def test_doi(spark, raw, out):
    assert _one(spark, raw, I.normalize_doi) == out


@pytest.mark.parametrize(("raw", "out"), [("arXiv:1234.5678v2", "1234.5678"), ("1234.5678 [cs.CL]", "1234.5678"), ("hep-th/9901001v3", "hep-th/9901001"), ("", None), (None, None)])
def test_arxiv(spark, raw, out):
    assert _one(spark, raw, I.normalize_arxiv) == out


@pytest.mark.parametrize(("raw", "out"), [("  Hello,  World! ", "hello world"), ("Naïve Bayes", "nave bayes"), (None, ""), ("!!!", "")])
def test_title(spark, raw, out):
    assert _one(spark, raw, I.normalize_title) == out


def test_paper_ids_by_priority(spark):
    df = spark.createDataFrame([("10.1/A", "1.2", "T"), (None, "1.2v3", "T"), ("", "", "A Title"), (None, None, "a  title!"), (None, None, None), (None, None, "")], "d string, a string, t string")
    ids = [r[0] for r in df.select(I.paper_id(F.col("d"), F.col("a"), F.col("t"))).collect()]
    assert ids[:2] == ["doi:10.1/a", "arxiv:1.2"] and ids[2] == ids[3] and ids[2].startswith("title:") and len(ids[2]) == 22 and ids[4] == ids[5] and ids[4].startswith("unknown:")


def test_preprint_addresses(spark):
    df = spark.createDataFrame([("10.1101/2020.1", None), ("10.1101/2020.1", "https://www.medrxiv.org/x"), ("10.2139/ssrn.123", None), ("10.31234/osf.io/ab1", None), ("10.26434/chem", None), ("10.5/x", None)], "d string, oa string")
    got = [r[0] for r in df.select(I.preprint_url(F.col("d"), F.col("oa"), F.lit(3))).collect()]
    assert got[0].endswith("biorxiv.org/content/10.1101/2020.1v3.full.pdf") and "medrxiv" in got[1] and "SSRN_ID123" in got[2] and got[3] == "https://osf.io/ab1/download" and got[4].endswith("10.26434/chem/original") and got[5] is None


@pytest.mark.parametrize(
    ("anchor", "candidate", "out"), [(2020, 2019, 2019), (2020, 2018, 2018), (2020, 2017, 2020), (2020, 2021, 2020), (None, 2019, 2019), (2020, None, 2020), (1900, 2019, 2019), (2020, 1950, 2020), (None, None, None)]
)
def test_older_year_within_the_gap(spark, anchor, candidate, out):
    df = spark.createDataFrame([(anchor, candidate)], "a int, c int")
    assert df.select(Y.older_within_gap(F.col("a"), F.col("c"), 2026)).first()[0] == out


@pytest.mark.parametrize(("anchor", "candidate", "out"), [(2020, 2019, 2019), (2020, 2017, None), (None, 2019, 2019), (2020, 2020, None), (None, 1900, None)])
def test_candidate_years(spark, anchor, candidate, out):
    df = spark.createDataFrame([(anchor, candidate)], "a int, c int")
    assert df.select(Y.better_candidate(F.col("a"), F.col("c"), 2026)).first()[0] == out


def test_small_text_functions(spark):
    assert _one(spark, "x" * 60, lambda c: T.short_label(c, F.lit(2001))) == "x" * 49 + "… (2001)" and _one(spark, None, lambda c: T.short_label(c, F.lit(None).cast("int"))) == "(untitled)"
    assert _one(spark, "The deep model for a novel thing using words", T.query_words) == "deep model thing words"
    assert _one(spark, "a/b:c?.pdf", T.safe_filename) == "a_b_c_.pdf" and _one(spark, "secretkey", T.mask) == "secr*****" and _one(spark, "abc", T.mask) == "***"
    assert _one(spark, '<a href="x">&', T.escape_xml) == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert _one(spark, {"world": [1], "hello": [0, 2]}, T.from_inverted_index, "map<string, array<int>>") == "hello world hello"
    assert _one(spark, ["b", "a"], T.fnv1a, "array<string>") == _one(spark, ["a", "b"], T.fnv1a, "array<string>")


def test_scores_by_words_in_any_order():
    assert token_sort("a b c", "c b a") == 100 and token_set("deep nets", "deep nets for text") == 100 and title_score("deep nets", "deep nets for text") < 88
    assert ratio("", "") == 100 and token_set("", "a") == 0 and title_score("graph neural networks", "graph neural network") > 95


def test_fuzzy_pairs_lose_none(spark):
    import random

    rng = random.Random(1)
    words = ["graph", "neural", "network", "deep", "text", "model", "learning", "corpus"]
    a = sorted({" ".join(rng.sample(words, 4)) for _ in range(40)} | {"x", ""})
    b = sorted({w.replace("e", "", 1) if rng.random() < 0.5 else w for w in a})
    want = {(x, y) for x in a for y in b if x and y and title_score(x, y) >= 85}
    left, right = (spark.createDataFrame([(t, 1) for t in side], f"{n} string, extra int") for n, side in (("a", a), ("b", b)))
    assert {(r.a, r.b) for r in fuzzy_pairs(left, right, 85).collect()} == want
    from refloom.functions import fuzzy

    old, fuzzy.BLOCK = fuzzy.BLOCK, 7
    try:
        assert {(r.a, r.b) for r in fuzzy_pairs(left, right, 85).collect()} == want
    finally:
        fuzzy.BLOCK = old
    assert fuzzy_pairs(left, right.limit(0), 85).count() == 0


@pytest.mark.parametrize("least", [60, 85, 88])
def test_near_finds_what_all_pairs_have(monkeypatch, least):
    import random

    import numpy as np

    from refloom.functions import fuzzy

    for name, value in (("ROWS", 8), ("TILE", 40), ("PAIRS", 64)):  # many lots, the last ones not full
        monkeypatch.setattr(fuzzy, name, value)
    rng = random.Random(least)
    words = "graph neural networks network deep text texts model modelling learning corpus of for a and sparse 3d x".split()
    a = [" ".join(rng.choices(words, k=rng.randint(1, 24))) for _ in range(150)] + ["", "z" * 700, "na\u00efve \u0394 graph", "word " * 60]
    b = ["".join(c for c in t if rng.random() > 0.06) for t in a] + ["z" * 699, "naive d graph", rng.choice(words)]
    spec = fuzzy.spec_of(b)
    found = [lot for lot in fuzzy.near(fuzzy.side_of(a, spec), fuzzy.side_of(b, spec), least)]
    i, j, score = (np.concatenate(v) for v in zip(*found, strict=True))
    want = {(p, q): s for p, x in enumerate(a) for q, y in enumerate(b) if x.strip() and y.strip() and (s := token_sort(x, y)) >= least}
    got = {(p, q): s for p, q, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)}
    assert len(got) == len(i) and got == {k: s for k, s in want.items()} and len(got) < len(a) * len(b) / 2


def test_token_set_by_common_beginning():
    import random

    rng = random.Random(5)
    for _ in range(300):
        a, b = (" ".join(rng.choices("graph graphs deep net nets a of text".split(), k=rng.randint(1, 6))) for _ in range(2))
        x, y = set(a.split()), set(b.split())
        both, one, two = " ".join(sorted(x & y)), " ".join(sorted(x & y) + sorted(x - y)), " ".join(sorted(x & y) + sorted(y - x))
        want = 100.0 if both and (x <= y or y <= x) else max([ratio(one, two)] + ([ratio(both, one), ratio(both, two)] if both else []))
        assert token_set(a, b) == want


def test_later_providers_are_asked_for_the_rest(spark, monkeypatch):
    from refloom.plans import meta_queries

    asked, search = [], R.title_search

    def watched(bib, *rest):
        asked.append({r.entry_id for r in bib.select("entry_id").collect()})
        return search(bib, *rest)

    monkeypatch.setattr(R, "title_search", watched)
    stages = [(r.entry_id, r.stage) for r in meta_queries.title_search_cascade(spark, "/root/testdata/sf0.001").collect()]
    assert stages and len(asked) == 4 and all(asked[k] == asked[0] - {e for e, stage in stages if stage < k} for k in range(4))


def _bib(spark, rows):
    return spark.createDataFrame([(i, p, f"b{i}", t, "", None, y, d, a) for i, p, t, y, d, a in rows], "entry_id bigint, paper_id string, bib_key string, title string, raw string, authors array<string>, pub_year int, doi string, arxiv_id string")


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, doi string, arxiv_id string, added_at int, depth int")


def test_links_that_only_bibliographies_show(spark):
    nodes = _nodes(spark, [("p", "Paper", "10.1/p", None, 1, 0), ("q", "Some longer title here", "10.1/q", None, 1, 1), ("q2", "Other", "10.1/Q", None, 2, 3), ("r", "R", None, "1.2", 1, 1)])
    bib = _bib(spark, [(1, "p", "x", 2000, "https://doi.org/10.1/Q", "1.2"), (2, "p", "y" * 200, 2000, None, "arXiv:1.2v1"), (3, "p", None, None, "10.1/p", "1.2"), (4, "p", None, None, None, None), (5, "q", "z", None, None, "1.2")])
    primary = spark.createDataFrame([("q", "r")], "src string, dst string")
    got = {(r.src, r.dst): (r.depth, r.context) for r in R.secondary_edges(bib, nodes, primary).collect()}
    # The last node with a DOI counts; an entry that names its own paper ends the look-up; primary links are left out.
    assert set(got) == {("p", "q2"), ("p", "r")} and got[("p", "q2")] == (3, "bibliographic link (ref b1: x)") and len(got[("p", "r")][1]) == len("bibliographic link (ref b2: )") + 120


def test_links_by_title(spark):
    nodes = _nodes(spark, [("q", "Graph neural networks for text", None, None, 1, 1), ("s", "Short", None, None, 1, 1), ("p", "Graph neural networks for texts", None, None, 1, 0)])
    bib = _bib(spark, [(1, "p", "Graph Neural Network for Text!", None, None, None), (2, "p", "graph neural networks for text", None, None, None), (3, "p", "Short", None, None, None)])
    none = spark.createDataFrame([], "src string, dst string")
    assert [(r.src, r.dst, r.entry_id) for r in R.fuzzy_links(bib, nodes, none).collect()] == [("p", "q", 2)]
    assert R.fuzzy_links(bib, nodes, spark.createDataFrame([("p", "q")], "src string, dst string")).count() == 0


@pytest.mark.parametrize(("rule", "first", "out"), [("none", False, 1), ("after", False, None), ("before", False, 2), ("none", True, 1)])
def test_title_search_by_year_rules(spark, rule, first, out):
    bib = _bib(spark, [(7, "p", "Graph neural networks for text", 2000, None, None)])
    cand = spark.createDataFrame([(1, "Graph neural networks for text", 2010), (2, "Graph neural networks for texts", 2001), (3, "Another thing", 2000)], "rec_id bigint, title string, pub_year int")
    got = R.title_search(bib, cand, rule, first).collect()
    assert (got[0].rec_id if got else None) == out


def test_fields_from_the_first_that_has_one(spark):
    r = spark.createDataFrame([("p", 2, "", 0, []), ("p", 1, "t1", 5, None), ("p", 3, "t3", 7, ["x"])], "k string, rank int, title string, n int, authors array<string>")
    got = R.coalesce_records(r, "k", [F.col("rank")], ["title", "n", "authors"]).first()
    assert (got.title, got.n, got.authors) == ("t1", 5, ["x"])


def test_cache_states(spark):
    log = spark.createDataFrame([("s", 1, '{"a":1}', 1), ("s", 1, None, 2), ("s", 2, "{bad", 1), ("s", 3, "{}", 1)], "source string, key int, data string, at int")
    probes = spark.createDataFrame([("s", k) for k in (1, 2, 3, 4)], "source string, key int")
    assert {r.key: r.state for r in R.lookup_cache(probes, R.latest(log, ["source", "key"], ["at"]), ["source", "key"]).collect()} == {1: "negative", 2: "miss", 3: "hit", 4: "miss"}


def test_chunks_hold_so_many_keys(spark):
    df = spark.createDataFrame([(f"10.1101/{i:04}",) for i in range(120)] + [(None,)] * 3 + [("10.1101/0001",)], "doi string")
    n = {r.chunk: r["count"] for r in R.chunks(df, "doi").groupBy("chunk").count().collect()}
    assert n == {0: 50, 1: 50, 2: 20}


def test_circuit_opens_for_a_time(spark):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    calls = [("a", at(s), i, bad) for i, (s, bad) in enumerate([(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (60, True), (124, True), (125, True), (126, True), (127, False)])] + [("b", at(6), 99, True)]
    df = spark.createDataFrame(calls, "source string, ts timestamp_ntz, call int, failed boolean")
    got = {r.call: (r.allowed, r.opened) for r in R.breaker(df).collect()}
    assert [i for i, (ok, _) in sorted(got.items()) if not ok] == [6, 7]
    assert got[5] == (True, True) and got[99] == (True, False)


def test_payloads_in_one_form(spark):
    a = '{"title": "T", "year": 2001, "externalIds": {"DOI": "10.1/A", "ArXiv": "1.2v1"}, "authors": [{"name": "Ann"}, {"name": null}], "openAccessPdf": {"url": "u"}, "citationCount": 0}'
    b = '{"doi": "https://doi.org/10.1/B", "title": "W", "publication_year": 2002, "authorships": [{"author": {"display_name": "Bob"}}], "abstract_inverted_index": {"b": [1], "a": [0]}, "best_oa_location": {"landing_page_url": "l"}}'
    df = spark.createDataFrame([(1, "citation_index", a), (2, "work_index", b), (3, "work_index", "{bad"), (4, None, None)], "i int, kind string, payload string")
    r = {x.i: x for x in N.normalized(df).collect()}
    assert (r[1].doi, r[1].arxiv_id, r[1].authors, r[1].open_access_url, r[1].citation_count) == ("10.1/a", "1.2", ["Ann"], "u", 0)
    assert (r[2].doi, r[2].abstract, r[2].authors, r[2].open_access_url, r[2].year) == ("10.1/b", "a b", ["Bob"], "l", 2002)
    assert r[3].title is None and r[4].title is None


@pytest.mark.parametrize(("payload", "out"), [('{"title": "x"}', "x"), ('{"title": {"value": "x"}}', "x"), ('{"title": {"other": 1}}', None), ("{", None), ("{}", None), (None, None)])
def test_wrapped_values(spark, payload, out):
    assert _one(spark, payload, lambda c: N.unwrapped(c, "title")) == out


def test_nodes_of_citing_records(spark):
    df = spark.createDataFrame([("T", 2001, "10.1/a", None), (None, None, None, "1.2"), ("", 1, None, None), (" ", 1, "", ""), ("Only title", None, None, None)], "title string, year int, doi string, arxiv_id string")
    assert sorted(r.id.split(":")[0] for r in N.citing_nodes(df).collect()) == ["arxiv", "doi", "title"]


def test_functions_for_sql(spark):
    register(spark)
    r = spark.sql("select norm_doi('https://doi.org/10.1/A') d, norm_arxiv('arXiv:1.2v3') a, norm_title(' A, b ') t, title_hash('a b') h, title_score('a b', 'b a') s").first()
    assert (r.d, r.a, r.t, r.s) == ("10.1/a", "1.2", "a b", 100.0) and len(r.h) == 16


def test_points_are_set_apart_and_spread(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.1, 0.2), ("c", 9.0, 9.0)], "id string, x double, y double")
    assert {r.id: r.x for r in uncollide(df, 10.0).collect()} == {"a": -5.0, "b": 5.1, "c": 9.0}
    assert {r.id: r.x for r in spread(df.filter("id <> 'b'"), 2.0).collect()} == {"a": -4.5, "c": 13.5}


def test_best_entry_of_a_node(spark):
    nodes = _nodes(spark, [("q", "Graph neural networks for text", "10.1/q", None, 1, 1), ("r", "Another long title here", None, "1.2", 1, 1), ("s", "Reading of small things", None, None, 1, 1), ("t", "Never cited at all here", None, None, 1, 1)])
    bib = _bib(spark, [(1, "p", "x", None, "10.1/Q", None), (2, "p", "y", None, "10.1/q", None), (3, "p", "z", None, None, "1.2v3"), (4, "p", "Reading of small thing", None, None, None), (5, "p", "reading of small things", None, None, None)])
    assert {r.id: (r.entry_id, r.by) for r in R.best_entry(bib, nodes).collect()} == {"q": (1, "doi"), "r": (3, "arxiv"), "s": (5, "title")}


def test_candidates_by_phrase_then_by_words(spark):
    bib = _bib(spark, [(1, "p", "Deep models of text", None, None, None), (2, "p", "The deep novel corpus", None, None, None), (3, "p", None, None, None, None), (4, "p", "of it", None, None, None)])
    rec = spark.createDataFrame([(i, "Deep Models of Text") for i in range(7)] + [(20, "A corpus that is deep"), (21, "A corpus"), (22, None)], "rec_id bigint, title string")
    got = sorted((r.entry_id, r.rec_id, r.strategy) for r in R.title_candidates(bib, rec).collect())
    assert got == [(1, i, "phrase") for i in range(5)] + [(2, 20, "words")]


@pytest.mark.parametrize("rare", [0, 3, 200])
def test_candidates_by_words_equal_brute_force_whatever_key_finds_them(spark, rare):
    import random

    rng = random.Random(3)
    vocab = ["graph", "neural", "network", "deep", "text", "model", "learning", "corpus", "of", "a", "rarely"]
    title = lambda n: " ".join(rng.choice(vocab[: 10 + (rng.random() < 0.1)]) for _ in range(n))
    bib = [(i, title(rng.randint(1, 5))) for i in range(60)] + [(60, "unknown graph"), (61, "Deep, deep"), (62, "a")]
    rec = [(i, title(rng.randint(2, 8))) for i in range(150)]
    whole = {e: [r for r, u in rec if u.lower() == t.lower().replace(",", "")][:5] for e, t in bib}
    want = {(e, r, "phrase") for e in whole for r in whole[e]}
    for e, t in bib:
        w = {x for x in t.lower().replace(",", "").split() if len(x) > 3}
        if w and not whole[e]:
            want |= {(e, r, "words") for r in [r for r, u in rec if w <= set(u.split())][:10]}
    frames = (spark.createDataFrame(rows, f"{k} bigint, title string") for k, rows in (("entry_id", bib), ("rec_id", rec)))
    got = [(r.entry_id, r.rec_id, r.strategy) for r in R.title_candidates(*frames, rare=rare).collect()]
    assert len(got) == len(want) and set(got) == want


def test_texts_are_encoded_by_a_model_loaded_once_a_task(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "k int, text string")
    out = {r.k: r.embedding for r in R.encoded_texts(df, "k", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert out == {1: [2.0, 1.0], 3: [0.0, 1.0]}
