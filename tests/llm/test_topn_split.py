import random

import pytest

from rankspark.llm import split, topn


def test_top_n(spark):
    """Ties by item, repeated and re-scored rows, null and NaN scores, null items and groups, clashing columns, empty tables."""
    nan = float("nan")
    rows = [(1, 5, 1.0), (1, 4, 1.0), (1, 3, 0.5), (1, 3, 2.0), (1, 3, 2.0), (1, 9, nan), (1, None, 9.0), (2, 1, None), (None, 1, 1.0), (3, 1, -0.0), (3, 0, 0.0), (4, 1, float("inf"))]
    frame = spark.createDataFrame([(*r, 7, 8.0) for r in rows], "g long, i long, s double, item long, rank_no double")
    got = sorted(((r.group_key is not None, r.group_key, r.rank_no, r.item) for r in topn.top_n(frame, "g", "i", "s", 2).collect()), key=repr)
    assert got == sorted([(True, 1, 1, 3), (True, 1, 2, 4), (False, None, 1, 1), (True, 3, 1, 0), (True, 3, 2, 1), (True, 4, 1, 1)], key=repr)
    lists = {r.group_key: (r.ranked_ids, r.top_scores) for r in topn.top_lists(frame, "g", "i", "s", 2).collect()}
    assert lists[1] == ([3, 4], [2.0, 1.0])
    assert topn.top_n(frame.limit(0), "g", "i", "s").count() == 0
    with pytest.raises(ValueError):
        topn.top_n(frame, "g", "i", "s", 0)


def test_top_n_against_brute_force_and_its_plan(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(300), rng.randrange(40) / 4) for _ in range(5000)]
    frame = spark.createDataFrame(rows, "g long, i long, s double").repartition(7)
    best = {}
    for g, i, s in rows:
        best[g, i] = max(s, best.get((g, i), s))
    expected = {(g, n, i) for g in (1, 2, 3) for n, (_, i) in enumerate(sorted((-s, i) for (h, i), s in best.items() if h == g)[:10], 1)}
    out = topn.top_n(frame, "g", "i", "s", 10)
    assert {(r.group_key, r.rank_no, r.item) for r in out.collect()} == expected
    again = topn.top_n(frame, "g", "i", "s", 10)._jdf.queryExecution().executedPlan().toString()
    assert again.count("WindowGroupLimit") == 2  # before and after the shuffle


def pieces(spark, text, size, overlap, unit="word"):
    frame = spark.createDataFrame([(1, text, size, overlap, "x", "y")] * 2, "k long, t string, s int, o int, u string, ends string")
    return sorted(split.split_oversized(frame, "k", "t", "s", "o", unit).collect(), key=lambda r: r.piece_no)


def check(text, got, size, overlap):
    whole, new, before = text.split(), [], None
    for r in got:
        words = r.piece.split()
        assert 0 < len(words) == r.units <= size
        if before is not None:
            assert words[:overlap] == before[len(before) - overlap :] if overlap else True
        new += words[overlap if before is not None else 0 :]
        before = words
    assert new == whole


def test_split_keeps_every_word_and_its_limits(spark):
    rng = random.Random(5)
    ends = ["", "", "", "", ",", ".", ".\n\n", "\n", ";"]
    for size, overlap in ((8, 2), (5, 0), (3, 2), (1, 0), (40, 8)):
        text = " ".join(f"w{n}{rng.choice(ends)}" for n in range(200))
        got = pieces(spark, text, size, overlap)
        check(text, got, size, overlap)
        assert len(got) == got[0].pieces > 1


def test_split_cuts_where_the_text_breaks(spark):
    text = "One two three. Four five six seven\n\neight nine, ten eleven twelve thirteen. Fourteen fifteen sixteen"
    assert [r.piece for r in pieces(spark, text, 8, 0)] == ["One two three. Four five six seven", "eight nine, ten eleven twelve thirteen.", "Fourteen fifteen sixteen"]
    assert [r.piece for r in pieces(spark, "aa bb, cc dd ee", 4, 1)] == ["aa bb,", "bb, cc dd ee"]


def test_split_defined_cases(spark):
    assert [r.piece for r in pieces(spark, " a  b ", 2, 1)] == [" a  b "] and [r.piece for r in pieces(spark, "a b c", None, 5)] == ["a b c"]
    assert pieces(spark, None, 2, 1) == pieces(spark, "", 2, 1) == pieces(spark, "  \n", 2, 1) == []
    check("a b c d", pieces(spark, "a b c d", 2, 9), 2, 1)
    check("a b c d", pieces(spark, "a b c d", 0, -3), 1, 0)
    long = "word, " * 60_000
    check(long, pieces(spark, long, 5000, 100), 5000, 100)
    letters = "".join(r.piece[0 if r.piece_no == 1 else 2 :] for r in pieces(spark, "x" * 95 + "é👩", 10, 2, "char"))
    assert letters == "x" * 95 + "é👩"
    empty = spark.createDataFrame([], "k long, t string, s int, o int")
    assert split.split_oversized(empty, "k", "t", "s", "o").count() == 0
    assert [r.key for r in split.oversized(spark.createDataFrame([(1, "a b", 1, 0), (2, "a", 1, 0), (1, "a b", 1, 0)], "k long, t string, s int, o int"), "k", "t", "s", "o").collect()] == [1]
