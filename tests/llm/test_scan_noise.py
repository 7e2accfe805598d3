import random

from refloom.llm import pages as P
from refloom.llm import scan_noise as N
from refloom.llm.names import edit

_SCHEMA = "paper_id string, text string, title string, authors array<string>, text_origin string, line_no int"
_CLEAN = "The example of the text explains the modern method. The example shows modern words in the text.\n" * 30


def _papers(spark, scans):
    rows = [(f"c{i}", _CLEAN, None, None, "tei", 0) for i in range(3)] + [(pid, text, title, authors, "scan", 0) for pid, text, title, authors in scans]
    return spark.createDataFrame(rows, _SCHEMA)


def _spots(spark, scans):
    return sorted((r.paper_id, r.line_no, r.noise_kind, r.fixed_word) for r in N.noise_spots(_papers(spark, scans)).collect())


def test_kinds_of_noise(spark):
    text = "The exam-\nple of the text.\n\n7\n\x0cGruber et al.\nThe rnodern method.\n\n8\n\x0cGruber et αl.\nA self-\nevident text."
    got = _spots(spark, [("p", text, "Some Other Title Of The Work", ["Anna Gruber"])])
    assert [g for g in got if g[2] != "split_word"] == [("p", 3, "page_number", ""), ("p", 4, "running_head", ""), ("p", 5, "misread_word", "modern"), ("p", 7, "page_number", ""), ("p", 8, "running_head", "")]
    assert ("p", 0, "split_word", "example") in got


def test_paper_delivered_twice_is_repaired_alike(spark):
    text = "The exam-\nple of the text.\nThe rnodern method."
    once = {(r.paper_id, r.text) for r in N.repaired(_papers(spark, [("p", text, None, None)])).collect()}
    twice = [(r.paper_id, r.text) for r in N.repaired(_papers(spark, [("p", text, None, None), ("p", text, None, None)])).collect()]
    assert once == {("p", "The example of the text. The modern method.")} and len(twice) == 2 and set(twice) == once
    assert _spots(spark, [("p", text, None, None)] * 2) == _spots(spark, [("p", text, None, None)])


def test_two_letter_words_and_other_scripts_are_corrected(spark):
    clean = "Слово d0м стоит. " + "Слово of дом стоит. " * 60
    rows = [("c", clean.replace("d0м ", ""), None, None, "tei", 0), ("p", "Слово 0f дом стоит.", None, None, "scan", 0)]
    got = {(r.noise_kind, r.fixed_word) for r in N.noise_spots(spark.createDataFrame(rows, _SCHEMA)).collect()}
    assert got == {("misread_word", "of")}


def test_long_words_are_counted_and_corrected(spark):
    word = "m" + "abcdefghij" * 14
    rows = [("c", f"{word} stands. " * 60, None, None, "tei", 0), ("p", f"rn{word[1:]} stands.", None, None, "scan", 0)]
    got = {(r.noise_kind, r.fixed_word) for r in N.noise_spots(spark.createDataFrame(rows, _SCHEMA)).collect()}
    assert got == {("misread_word", word)}


def test_null_empty_and_no_rows(spark):
    assert _spots(spark, [("p", None, None, None), ("q", "", "t", []), ("r", "  \n ", None, [None])]) == []
    assert N.noise_spots(spark.createDataFrame([], _SCHEMA)).count() == 0 and N.repaired(spark.createDataFrame([], _SCHEMA)).count() == 0
    assert {r.text for r in N.repaired(_papers(spark, [("p", None, None, None)])).collect()} == {None}


def test_anagram_values_differ_by_the_shapes_alone():
    assert N.anagram_value("modern") - N.anagram_value("rnodern") == N.anagram_value("m") - N.anagram_value("rn")
    assert N.anagram_value("字" * 50) > 0


def test_number_in_a_table_is_no_page_number():
    lines = ["Some text here", "1984", "and more text", "12.5 7.3 9"]
    assert P.furniture(lines, None, None) == {}


def test_bounded_edit_distance_equals_brute_force():
    def slow(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(1)
    for _ in range(3000):
        a, b, most = "".join(rng.choices("abc", k=rng.randint(0, 8))), "".join(rng.choices("abc", k=rng.randint(0, 8))), rng.randint(0, 4)
        assert edit(a, b, most) == min(slow(a, b), most + 1)


def test_planted_noise_is_found(spark):
    rng = random.Random(5)
    words = ["modern", "clinical", "minimal", "harmony", "chronic", "learning", "burner", "corner", "turning", "morning", "calendar", "riddle"]
    clean = " ".join(rng.choice(words) for _ in range(6000))
    scans, truth = [], set()
    for p in range(40):
        lines = []
        for n in range(12):
            line = [rng.choice(words) for _ in range(8)]
            if n % 3 == 0:
                k = rng.randrange(1, 7)
                bad = line[k].replace("rn", "m").replace("m", "rn", 1) if "rn" not in line[k] and "m" in line[k] else line[k].replace("d", "cl", 1) if "d" in line[k] else line[k]
                if bad != line[k]:
                    truth.add((f"p{p}", n, "misread_word", line[k]))
                    line[k] = bad
            lines.append(" ".join(line))
        scans.append((f"p{p}", "\n".join(lines), None, None))
    df = spark.createDataFrame([("c", clean, None, None, "tei", 0)] + [(*s, "scan", 0) for s in scans], _SCHEMA)
    got = {(r.paper_id, r.line_no, r.noise_kind, r.fixed_word) for r in N.noise_spots(df).collect()}
    assert len(truth & got) >= 0.9 * len(truth) and len(truth & got) >= 0.9 * len(got)
