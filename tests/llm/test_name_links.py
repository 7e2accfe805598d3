import random

from refloom.llm.name_links import shortened, token_stars
from refloom.llm.names import edit, near


def _stars(spark, counts):
    return {r.token: r.star for r in token_stars(spark.createDataFrame([(t, n, 1) for t, n in counts.items()], "token string, n bigint, beside bigint")).collect()}


def test_slip_of_a_name_that_is_like_a_more_frequent_one_keeps_its_family(spark):
    s = _stars(spark, {"pledrostemu": 53, "pledristelu": 50, "pledristeul": 3, "pledrostemmu": 2})
    assert s == {"pledrostemu": "pledrostemu", "pledrostemmu": "pledrostemu", "pledristelu": "pledristelu", "pledristeul": "pledristelu"}


def test_chain_of_single_slips_shares_a_star(spark):
    s = _stars(spark, {"ridkurafe": 10, "ridukrafe": 10, "ridukrrafe": 7})
    assert set(s.values()) == {"ridkurafe"}


def test_slip_near_two_names_joins_the_nearer_one(spark):
    s = _stars(spark, {"pledrostemu": 53, "pledristelu": 50, "pledristeul": 3, "pledrostelu": 2})
    assert s["pledristeul"] == s["pledristelu"] == "pledristelu" and s["pledrostelu"] == "pledrostemu"
    s = _stars(spark, {"brastugrilo": 53, "brestugrila": 50, "brestugrlia": 3, "brestugrilos": 2})
    assert s["brestugrila"] == s["brestugrlia"] == "brestugrila" and s["brestugrilos"] == "brastugrilo"


def test_every_near_pair_shares_a_shortened_form():
    rng = random.Random(5)

    def slip(t):
        i = rng.randrange(len(t) - 1)
        return rng.choice([t[:i] + t[i + 1] + t[i] + t[i + 2 :], t[:i] + t[i + 1 :], t[:i] + "q" + t[i:], t[:i] + "q" + t[i + 1 :]])

    for _ in range(600):
        t = "".join(rng.choices("aeioulnrst", k=rng.randint(6, 13)))
        for u in (slip(t), slip(slip(t))):
            if near(t, u) or edit(t, u, 1) <= 1:
                assert shortened(t) & shortened(u), (t, u)


def test_two_swaps_in_a_long_token_are_found(spark):
    assert _stars(spark, {"ferwetohak": 9, "frewetoahk": 2}) == {"ferwetohak": "ferwetohak", "frewetoahk": "ferwetohak"}


def _classes(spark, names, **limits):
    from refloom.llm.name_links import name_classes

    out = {}
    for r in name_classes(spark.createDataFrame([(n, "x") for n in names], "name string, class string"), **limits).collect():
        out.setdefault(r["class"], set()).add(r.name)
    return sorted(out.values(), key=sorted)


_NAMES = ["John A. Pledrostemu"] * 5 + ["J. Pledrostemu"] * 3 + ["Pledrostemu, John"] * 2 + ["PLEDROSTEMU J A", "Jon Pledrostemu", "John Pledrotsemu", "Maria Pledrostemu", "M. Pledrostemu", "Bob Kravitasol", "Robert Kravitasol", "Robert Kravitasol", "Wei Li", "Li, Wei"]
# Given names stand beside many families.
_NAMES += [f"{g} {f}" for g in ("Maria", "John", "Robert") for f in ("Dovakelin", "Testarosu", "Ullonvatik", "Brubekado")]


def test_spellings_of_one_person_meet(spark):
    got = _classes(spark, _NAMES + [None, "", "et al."])
    john = next(c for c in got if "John A. Pledrostemu" in c)
    assert {"J. Pledrostemu", "Pledrostemu, John", "PLEDROSTEMU J A", "John Pledrotsemu"} <= john and not john & {"Maria Pledrostemu", "M. Pledrostemu"}
    assert {"Bob Kravitasol", "Robert Kravitasol"} in got and {"Wei Li", "Li, Wei"} in got and {"Maria Pledrostemu", "M. Pledrostemu"} in got


def test_hot_buckets_give_the_same_classes(spark):
    assert _classes(spark, _NAMES, hot_rows=2) == _classes(spark, _NAMES)


def test_no_names_no_classes(spark):
    assert _classes(spark, []) == [] and _classes(spark, [None, ""]) == []


def test_star_centres_equal_going_through_all_in_order(spark):
    from refloom.llm.name_links import star_centres

    rng = random.Random(2)
    for _ in range(3):
        n = 40
        edges = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(70)) if a != b}
        centres: set[int] = set()
        for i in sorted({x for e in edges for x in e}):
            if not any((i, c) in edges for c in centres):
                centres.add(i)
        got = {r.centre for r in star_centres(spark.createDataFrame(sorted(edges), "late bigint, early bigint")).collect()}
        assert got == centres
    assert star_centres(spark.createDataFrame([], "late bigint, early bigint")).count() == 0


def test_chain_of_readings_ends(spark):
    from refloom.llm.name_links import star_centres

    chain = spark.createDataFrame([(i + 1, i) for i in range(9)], "late bigint, early bigint")
    assert {r.centre for r in star_centres(chain).collect()} == {0, 2, 4, 6, 8}


def test_bands_reach_the_recall_they_are_tuned_for():
    from refloom.llm.name_links import LEAST_SIMILARITY, RECALL, ROWS, MinHash, bands
    from refloom.llm.names import trigrams

    assert 1 - (1 - LEAST_SIMILARITY**ROWS) ** bands() >= RECALL
    rng, hashes, met, n = random.Random(4), MinHash(), 0, 0
    for _ in range(400):
        t = "".join(rng.choices("abcdefghijklmnop", k=12))
        i = rng.randrange(11)
        u = t[:i] + rng.choice("xyz") + t[i + 1 :]
        a, b = trigrams(t), trigrams(u)
        if len(a & b) / len(a | b) >= LEAST_SIMILARITY:
            n += 1
            met += bool(set(hashes.keys(t)) & set(hashes.keys(u)))
    assert n > 200 and met >= 0.98 * n
