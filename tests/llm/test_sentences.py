import random

import pytest

from refloom.llm.sentences import sentence_spans


def _units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


def test_ends_before_and_after_a_long_row_of_false_stops():
    names = ", ".join(f"{a}. {b}. Gruber" for a, b in zip("ABCDEFGHIJ", "KLMNOPQRST", strict=True))
    assert _units(f"The work is done. It was shown by {names} in turn. Others agree.") == ["The work is done.", f"It was shown by {names} in turn.", "Others agree."]


@pytest.mark.parametrize("text", ["...", ". . . . ", "1. 2. 3. A. B.", "(...) ... No! ?! ... Yes. "])
def test_rows_of_stops_give_units_in_order(text):
    spans = sentence_spans(text)
    assert spans == sorted(spans) and all(a < b for a, b in spans)


def test_long_line_is_cut_like_its_sentences():
    rng = random.Random(3)
    parts = [f"Word {rng.randint(1, 9)} stands alone." for _ in range(400)]
    assert _units(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "text",
    [
        "ខ្ញុំចូលចិត្តអានសៀវភៅ និងស្តាប់តន្ត្រី នៅផ្ទះ។",
        "ကျွန်တော် စာအုပ် ဖတ်ရတာ ကြိုက်တယ်။",
        "ແມວດຳ ໝາຂາວ ແລະນົກນ້ອຍ",
        "แมวสีดำ หมูสีขาว และนกตัวเล็ก",
    ],
)
def test_blank_before_an_unknown_word_is_no_end(text):
    assert _units(text) == [text]


def test_khmer_and_burmese_end_at_their_terminators():
    assert _units("ខ្ញុំអាន សៀវភៅ។ គាត់ទៅផ្ទះ។") == ["ខ្ញុំអាន សៀវភៅ។", "គាត់ទៅផ្ទះ។"]
    assert _units("စာအုပ် ဖတ်တယ်။ အိမ်ပြန်တယ်။") == ["စာအုပ် ဖတ်တယ်။", "အိမ်ပြန်တယ်။"]


def test_lao_ends_before_an_opener_and_after_a_final_particle():
    assert _units("ລາວອ່ານປຶ້ມ ດັ່ງນັ້ນລາວຮູ້ ແລະຈື່") == ["ລາວອ່ານປຶ້ມ", "ດັ່ງນັ້ນລາວຮູ້ ແລະຈື່"]
    assert _units("ລາວໄປແລ້ວ ໝາຢູ່ບ້ານ") == ["ລາວໄປແລ້ວ", "ໝາຢູ່ບ້ານ"]


def test_acronym_before_a_name_ends_nothing():
    assert _units("The U.S. Supreme Court ruled. It sits in the U.S. The end.") == ["The U.S. Supreme Court ruled.", "It sits in the U.S.", "The end."]


def test_japanese_and_chinese_end_at_final_particles_before_a_blank():
    assert _units("これは本です それは猫です") == ["これは本です", "それは猫です"]
    assert _units("他来了吗 我不知道") == ["他来了吗", "我不知道"]
    assert _units("新しい 本を読む") == ["新しい 本を読む"]


def test_quotations_citations_decimals_and_headings():
    assert _units("He said “It works. Really.” and left. It rose by 3.5 points.[2] See Fig. 3 for more.") == ["He said “It works. Really.” and left.", "It rose by 3.5 points.[2]", "See Fig. 3 for more."]
    assert _units("2 Methods\nWe use it.\n- a point\n") == ["2 Methods", "We use it.", "- a point"]


@pytest.mark.parametrize("text", ["a." * 50_000, "A. " * 30_000, "“x. " * 30_000, "ก" * 50_000 + " " + "ข" * 50_000, "x" * 500_000])
def test_very_long_texts(text):
    spans = sentence_spans(text)
    assert spans == sorted(spans) and all(a < b for a, b in spans)


def test_null_and_blank():
    assert sentence_spans(None) == [] == sentence_spans("") == sentence_spans(" \n\t ")


def test_rows_with_repeats_and_other_columns(spark):
    from refloom.llm.q_sentences import sentences

    df = spark.createDataFrame([("t", "1", "One. Two.", 3)] * 2 + [("t", "2", None, 3)], "src_table string, row_key string, text string, unit int")
    assert sorted((r.row_key, r.start_pos, r.end_pos, r.unit) for r in sentences(df).collect()) == [("1", 0, 4, "One.")] * 2 + [("1", 5, 9, "Two.")] * 2
