import os
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from rankspark.llm import bpe

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXTS = ["", None, " ", "the cat's mat", "  two  spaces ", "é 你好 👩‍👩‍👧 مرحبا", "\n\n\tx y z ", "<|endoftext|>", "a" * 3000, " " * 2000 + "b", "ab" * 300 + " " + "你好" * 400, "don't we'll 1234 !!! ''s", "a\x1cb\x85c", "﻿​"]


@pytest.fixture(scope="module")
def ranks():
    """A small vocabulary of our own: all bytes and some merges."""
    rng = random.Random(4)
    pieces = [bytes([i]) for i in range(256)]
    letters = [b"a", b"b", b" ", b"t", b"h", b"e", b"\xe4", b"\xbd"]
    have = list(letters)
    while len(pieces) < 500:
        new = rng.choice(have) + rng.choice(have)
        if new not in pieces and len(new) <= 8:
            pieces.append(new)
            have.append(new)
    return {p: i for i, p in enumerate(pieces)}


def expected(ranks, text):
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or "")


@pytest.mark.parametrize("dictionary", [1, 1000])
def test_ids_and_round_trip(spark, ranks, dictionary):
    """Null, empty, blank, odd and long texts, words in and outside the dictionary, repeated rows, clashing columns."""
    rows = [(i, t, "k", [1]) for i, t in enumerate(TEXTS)] + [(0, "", "k", [1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string, ids array<int>")
    out = bpe.encode_corpus(frame, ranks, dictionary_words=dictionary, buckets=64).withColumn("back", bpe.decode_ids(F.col("ids"), ranks)).collect()
    assert sorted((r.key, tuple(r.ids), r.back) for r in out) == sorted((i, tuple(expected(ranks, t)), t or "") for i, t, *_ in rows)


def test_empty_table_and_unknown_ids(spark, ranks):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_corpus(empty, ranks, buckets=64).count() == 0
    assert spark.range(1).select(bpe.decode_ids(F.array(F.lit(999_999)), ranks).alias("x")).first().x is None


def test_public_vocabulary(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    ranks = bpe.read_ranks(path)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.key: r.ids for r in bpe.encode_corpus(frame, ranks).collect()} == {i: expected(ranks, t) for i, t in enumerate(TEXTS)}


def test_words_of_any_length(spark, ranks):
    """Words of up to 100 kB go through the fold like others."""
    rng = random.Random(9)
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    cases = [(ranks, ["a" * 100_000, "".join(rng.choices("abth", k=1_500)), "ab" * 20_000])]
    if os.path.exists(path):
        cases.append((bpe.read_ranks(path), ["a" * 100_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=1_500)), "=" * 50_001, "schokolade" * 10_000]))
    for own, texts in cases:
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.key: r.ids for r in bpe.encode_corpus(frame, own, dictionary_words=1).collect()} == {i: expected(own, t) for i, t in enumerate(texts)}


def test_a_pair_of_lower_rank_overtakes(spark):
    """Vocabularies in which a joined piece makes a pair that ranks before the one just joined, against one-by-one merging."""
    rng = random.Random(12)
    for _ in range(3):
        pieces = [bytes([i]) for i in range(256)]
        more = {bytes(rng.choices(b"ab", k=rng.randrange(2, 6))) for _ in range(14)}
        own = {p: i for i, p in enumerate(pieces + sorted(more, key=lambda p: (rng.random(), p)))}
        texts = ["".join(rng.choices("ab", k=rng.randrange(1, 40))) for _ in range(60)]
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.key: r.ids for r in bpe.encode_corpus(frame, own, dictionary_words=1, buckets=64).collect()} == {i: expected(own, t) for i, t in enumerate(texts)}
