import random

import numpy as np

from rankspark.llm import neardup


def brute(rows, threshold):
    import re

    sets = {}
    for key, *texts in rows:
        if key is not None:
            words = frozenset(re.findall("[a-z0-9]+", " ".join(t or "" for t in texts).lower()))
            sets.setdefault(key, set()).add(words)
    return {(a, b) for a in sets for b in sets if a < b and any(x and y and len(x & y) / len(x | y) >= threshold for x in sets[a] for y in sets[b])}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "id long, name string, about string, words string, set_id int")


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = out[rng.randrange(len(out))][2].split()
            for _ in range(rng.randrange(8)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.randrange(15, 60))
        rng.shuffle(words)
        out.append((i, f"Name {i % 7}", " ".join(words)))
    return out


def test_pairs_against_brute_force(spark):
    rows = corpus(250)
    got = {(r.key_a, r.key_b) for r in neardup.similar_pairs(frame(spark, rows), "id", ["name", "about"], 0.7).collect()}
    assert got == brute(rows, 0.7) and len(got) > 50


def test_defined_cases(spark):
    """Nulls, no words, repeated rows, copies under other keys, case and order, a key with two contents, long texts, no rows."""
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, "A b", None), (1, "A b", None), (2, "b, a!", ""), (3, None, None), (4, "", " "), (5, None, None), (None, "a b", None), (6, "c d e f", None), (6, "a b", None), (7, "c d e f g", None), (8, long, None), (9, long + " y", None)]
    got = {(r.key_a, r.key_b) for r in neardup.similar_pairs(frame(spark, rows), "id", ["name", "about"], 0.7).collect()}
    assert got == {(1, 2), (1, 6), (2, 6), (6, 7), (8, 9)}
    classes = {r.key: (r.class_id, r.copies) for r in neardup.duplicate_classes(frame(spark, rows), "id", ["name", "about"], 0.7).collect()}
    assert classes[2] == (1, 3) and classes[8][0] == classes[9][0] == 8 and 3 not in classes
    assert neardup.similar_pairs(frame(spark, rows).limit(0), "id", ["name", "about"]).count() == 0
    assert neardup.duplicate_classes(frame(spark, rows).limit(0), "id", ["name", "about"]).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = {r.id: r.class_id for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_two_permutations_and_their_estimate():
    x = np.arange(1 << 20, dtype=np.uint32)
    assert len(np.unique(neardup.sigma(x))) == len(np.unique(neardup.pi(x))) == len(x)
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 32, 140, dtype=np.uint32)
    both = np.concatenate([words[:100], words[40:]])  # 60 in common of 140
    signature = neardup.signatures(both, np.array([0, 100]), 2000)
    assert abs((signature[:, 0] == signature[:, 1]).mean() - 60 / 140) < 0.04


def test_a_key_with_several_contents_joins_their_classes(spark):
    rows = [(6, "c d e f", ""), (6, "a b", ""), (7, "c d e f g", ""), (9, "c d e f g", ""), (1, "a b", ""), (2, "a b", ""), (3, "x y", "")]
    got = {r.key: (r.class_id, r.copies, r.links) for r in neardup.duplicate_classes(frame(spark, rows), "id", ["name", "about"], 0.7).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 6: 1, 7: 1, 9: 1, 3: 3}
    assert got[6] == (1, 3, 1) and got[7] == (1, 2, 1) and got[3] == (3, 1, 0)


def test_hot_bands_are_cut_into_parts(spark, monkeypatch):
    """The same pairs whether a band counts as hot or not, and however many parts it has."""
    rows = corpus(250, 4)
    for hot, part in ((1, 16), (16, 64)):
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(neardup, "PART", part)
        got = {(r.key_a, r.key_b) for r in neardup.similar_pairs(frame(spark, rows), "id", ["name", "about"], 0.7).collect()}
        assert got == brute(rows, 0.7)


def test_banded_rows_are_never_broadcast(spark):
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"])], "set_id long, words array<string>")
    spark.sparkContext.getCheckpointDir() or neardup.use_checkpoints(spark)
    plan = neardup.similar_sets(sets, 0.7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [band" in plan and not any("BroadcastHashJoin" in line and "band" in line for line in plan.splitlines())
