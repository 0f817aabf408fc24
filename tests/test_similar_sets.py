"""Similar term sets: exact for short and long sets, and no pair on disk that isn't nearly one."""

import random

import pytest

from rankspark.operators import querygen


def shuffled(spark):
    """Bytes that this session has written for shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_frequent_words_make_no_pairs_on_disk(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    sets = {f"{i} text of some length": sorted(rng.sample(words, 4)) for i in range(6000)}
    usual, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    got = {(r.key_a, r.key_b) for r in querygen.similar_term_sets(spark.createDataFrame([*sets.items()], "k string, t array<string>"), "k", "t").collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert shuffled(spark) - before < 3e6
    same = {}
    for k, t in sorted(sets.items()):
        same.setdefault(tuple(t), []).append(k)
    assert got == {(a, b) for keys in same.values() for i, a in enumerate(keys) for b in keys[i + 1 :]} and len(got) > 100


@pytest.mark.parametrize(("threshold", "least"), [(0.8, 3), (0.5, 1), (0.9, 2), (1.0, 3), (0.94, 1)])
def test_every_pair_of_short_and_long_sets(spark, threshold, least):
    rng = random.Random(2)
    rows = []
    for n in [*range(14), 17, 18, 19, 25, 40]:
        for base in ([f"{n}w{i}" for i in range(n)], [f"w{i}" for i in range(n)]):
            for cut, more in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (2, 1)):
                own = base[: max(0, n - cut)] + [f"x{i}" for i in range(more)]
                rng.shuffle(own)
                rows.append((len(rows), own + own[:1]))  # a term given twice counts once
    rows += [rows[40], (-1, None), (rows[60][0], ["other", "words", "here"])]  # a repeated row; no terms; a key with two sets
    expected = {}
    for a, x in rows:
        for b, y in rows:
            if a < b and x and y and min(len({*x}), len({*y})) >= least and (j := len({*x} & {*y}) / len({*x} | {*y})) >= threshold:
                expected[a, b] = (len({*x} & {*y}), round(j, 9))
    found = querygen.similar_term_sets(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", threshold, least).collect()
    assert {(r.key_a, r.key_b): (r.both, round(r.similarity, 9)) for r in found} == expected and len(found) == len(expected)
