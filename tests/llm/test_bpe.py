import os
import random

import pytest

from refloom.llm import bpe

_FILE = os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(_FILE), reason="vocabulary file not on this machine")


@pytest.fixture(scope="module")
def ranks():
    with open(_FILE, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "Hello world", "  two  blanks \n\n", "don't WE'LL", "naïve 日本語 ไทย عربى 😀", "<|endoftext|>", "x" * 3000, "ab" * 500, "á" * 40, "1234567 890", "\x00�"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_public_encoder_and_decode_back(ranks, reference, text):
    ids = bpe.Encoder(ranks).encode(text)
    assert ids == reference.encode_ordinary(text) and bpe.decode(ids, ranks).decode() == text


def test_random_texts(ranks, reference):
    rng, enc = random.Random(2), bpe.Encoder(ranks)
    for _ in range(200):
        t = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x400, 0x4FF), rng.randint(0x3040, 0x30FF), 10])) for _ in range(rng.randint(0, 60)))
        assert enc.encode(t) == reference.encode_ordinary(t)


def test_merging_by_brute_force(ranks):
    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choices("abest ", k=rng.randint(1, 30))).encode()
        assert bpe.merge(piece, ranks) == slow(piece) or piece in ranks


def test_null_empty_and_lone_surrogates(spark, ranks):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "id bigint, text string")
    out = {r.id: r.ids for r in bpe.encoded(df, bpe.vocabulary(spark)).collect()}
    assert out == {1: [], 2: [], 3: bpe.Encoder(ranks).encode("a b")}
    assert bpe.Encoder(ranks).encode("\ud800") == bpe.Encoder(ranks).encode("�")
    assert {r.id: r.n_tokens for r in bpe.encoded(df, bpe.vocabulary(spark), counts_only=True).collect()} == {1: 0, 2: 0, 3: 2}


def test_vocabulary_without_known_pattern_is_refused(spark):
    with pytest.raises(ValueError, match="no pattern"):
        bpe.vocabulary(spark, "another")
