import pytest

from refloom.operators import search as S
from refloom.operators.matching import build_pattern, references_of, refs_in_windows, sentence_hits
from refloom.operators.views import highlight_spans, node_size, search, size_tier


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


@pytest.mark.parametrize(
    ("keyword", "text", "n"),
    [
        ("independent", "Independence and independently, not codependent.", 2),
        ("foo", "food foo Foo-bar afoo", 3),
        ("tensor factorisation", "tensor-factorisations tensorfactorisation tensor  factorisation", 2),
        ("baseline", "ébaseline baselineé Baselines", 2),
        ("c++", "c++ and C++11", 2),
    ],
)
def test_mentions(spark, keyword, text, n):
    assert S.mentions(_docs(spark, text), "id", [keyword]).count() == n
    assert len(S.mention_spans(text, [keyword])) == n


@pytest.mark.parametrize("keyword", ["", "  ", " - "])
def test_empty_keyword_is_refused(keyword):
    with pytest.raises(ValueError, match="empty"):
        build_pattern(keyword)


def test_windows_by_sentence_and_by_characters(spark):
    docs = _docs(spark, "One here. The recurrent net. It works! Done.", None, "")
    r = S.windows(S.mentions(docs, "id", ["recurrent"])).collect()
    assert [(x.sent_no, x.passage) for x in r] == [(1, "The recurrent net. It works!")]
    c = S.windows(S.mentions(docs, "id", ["recurrent"]), S.CHARACTERS, 5).collect()
    assert [x.passage for x in c] == ["The recurrent net."] and c[0].win_start == c[0].start_pos - 5


def test_mention_across_two_tiles_is_found_once(spark):
    r = S.windows(S.mentions(_docs(spark, "A tensor\nfactorisation is here. Next."), "id", ["tensor factorisation"])).collect()
    assert [(x.sent_no, x.start_pos) for x in r] == [(0, 2)]


def test_search_by_pattern_and_meaning(spark):
    docs = _docs(spark, "The recurrent net. A similar machine here. Short. Far away things happen.")
    vectors = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.4, 0.9]), (0, 2, [1.0, 0.0]), (0, 3, [0.39, 0.9])], "id int, sent_no int, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "kw_no int, query array<double>")
    r = S.numbered_hits(S.search(docs, "id", ["recurrent"], vectors=vectors, queries=queries), "id").orderBy("hit_no").collect()
    # The first sentence is hit by the pattern, the third is too short, the last is too far.
    assert [(x.match_type, x.start_pos, x.score) for x in r] == [("regex", 4, None), ("semantic", 18, 0.4)]
    assert S.search(docs, "id", ["recurrent"], S.CHARACTERS, 9, vectors, queries).count() == 1


def test_two_mentions_in_a_sentence_are_two_hits(spark):
    assert S.search(_docs(spark, "Baseline and baselines."), "id", ["baseline"]).select("passage").distinct().count() == 1
    assert S.search(_docs(spark, "Baseline and baselines."), "id", ["baseline"]).count() == 2


def test_references_have_to_lie_in_the_window_as_a_whole(spark):
    texts = spark.createDataFrame([("p", "A recurrent net [1]. Also [2] it [1]. Not [3].")], "paper_id string, text string")
    refs = spark.createDataFrame([("p", "b1", 16, 19), ("p", "b2", 26, 29), ("p", "b1", 33, 36), ("p", "b3", 42, 45), ("p", "b4", 30, 40)], "paper_id string, bib_key string, ref_start int, ref_end int")
    r = refs_in_windows(sentence_hits(texts, "paper_id", ["recurrent"]), refs, "paper_id").collect()
    assert [(x.ref_keys, x.n_refs) for x in r] == [("b1 b2", 2)]


def test_key_parsed_twice_keeps_its_later_entry(spark):
    refs = spark.createDataFrame([("p", "b1")], "paper_id string, bib_key string")
    bib = spark.createDataFrame([(1, "p", "b1"), (2, "p", "b1"), (3, "q", "b1")], "entry_id int, paper_id string, bib_key string")
    assert [x.entry_id for x in references_of(refs, bib).collect()] == [2]


def test_highlights_do_not_overlap(spark):
    r = highlight_spans(spark.createDataFrame([("a", "baseline model baselines")], "id string, text string"), ["baseline model", "baseline"]).collect()
    assert [(x.start_pos, x.end_pos, x.kw_no) for x in r] == [(0, 8, 1), (15, 24, 1)]


def test_sizes_tiers_and_node_search(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("root", 0.0), ("analyzed", 400.0)], "status string, v double")
    sizes = {m: [x[0] for x in df.select(node_size(m, F.col("v"), F.col("status"))).collect()] for m in ("hits", "pagerank", "betweenness", "degree")}
    assert all(s == [30.0, 80.0] for s in sizes.values())
    assert [x[0] for x in spark.createDataFrame([(60,), (61,), (600,), (601,)], "n int").select(size_tier(F.col("n"))).collect()] == ["small", "medium", "large", "huge"]
    nodes = spark.createDataFrame([("a", "Graph things", ["Ann"]), ("b", "Other", ["Graph Man"]), ("c", None, None)], "id string, title string, authors array<string>")
    assert [(x.id, x.score) for x in search(nodes, "graph").collect()] == [("a", 10), ("b", 5)] and search(nodes, "g").count() == 0
