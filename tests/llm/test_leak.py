import random
import re

import numpy as np
import pytest

from rankspark.llm import leak


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def brute(documents, items):
    out = set()
    for d, text in documents:
        own = f" {' '.join(words(text))} "
        for i, item in items:
            w = words(item)
            n = min(12, len(w))
            if any(f" {' '.join(w[a : a + n])} " in own for a in range(len(w) - n + 1) if n):
                out.add((d, i))
    return out


def run(spark, documents, items, **how):
    docs = spark.createDataFrame([(*d, "k", 3) for d in documents], "doc_id long, text string, key string, words int")
    asked = spark.createDataFrame([(*i, "k") for i in items], "item_id long, text string, lengths string")
    return leak.leaked_items(docs, asked, **how).collect()


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 7, 11, 12, 13, 30])))) for i in range(60)]
    documents = []
    for d in range(150):
        own = rng.choices(vocabulary, k=rng.randrange(0, 60))
        part = words(rng.choice(items)[1])
        at = rng.randrange(len(own) + 1)
        documents.append((d, ", ".join(own[:at] + part[rng.randrange(3) :] + own[at:]).upper()))
    for size in (200_000, 40):  # one block of items, and many
        assert {(r.key, r.item) for r in run(spark, documents, items, block_windows=size) if r.copied} == brute(documents, items)


def test_defined_cases(spark):
    """Null and wordless texts, repeated rows, ties, a passage across segments of a long text, no gap across documents."""
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu"
    filler = "word " * (leak.SEGMENT - 5)
    documents = [(1, None), (2, ""), (3, "!!"), (4, filler + passage + filler), (5, passage), (5, passage), (6, "alpha beta gamma delta epsilon zeta"), (7, "eta theta iota kappa lam mu nu")]
    items = [(10, passage), (10, passage), (11, None), (12, ""), (13, passage), (None, passage)]
    got = [(r.key, r.item, r.copied) for r in run(spark, documents, items)]
    assert sorted(got, key=repr) == sorted([(k, i, True) for k in (4, 5, 5) for i in (10, 13, None)], key=repr)
    assert run(spark, documents[:0], items) == [] and run(spark, documents, items[:0]) == []


def test_near_copies_are_found_and_told_apart(spark):
    text = " ".join(f"longish{i}" for i in range(60))
    changed = text.replace("longish59", "x")
    rows = run(spark, [(1, changed)], [(1, text)], window=60, radius=15, similarity=0.8)
    assert len(rows) == 1 and not rows[0].copied and 0.8 <= rows[0].similarity < 1


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(7)
    sets = [(i, rng.integers(0, 1 << 63, 14, dtype=np.uint64), np.full(14, 5, np.int32)) for i in range(50)]
    index = leak.Index(sets, 12, 5, 3)
    own = index.sizes[12][0]
    asked = own[rng.integers(0, len(own), 400)].copy()
    for _ in range(4):
        asked ^= np.where(rng.random(400) < 0.8, np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64), np.uint64(0))
    near = {(a, b) for a in range(400) for b in range(len(own)) if int(asked[a] ^ own[b]).bit_count() <= 3}
    assert set(zip(*(x.tolist() for x in index.near(12, asked)))) == near and near
    with pytest.raises(ValueError):
        leak.Index(sets, 12, 5, 1)
    wide = leak.Index(sets, 12, (1, 2, 3, 4, 5), 15)
    own = wide.sizes[12][0]
    asked = own[rng.integers(0, len(own), 400)] ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64) for _ in range(14)])
    near = {(a, b) for a in range(400) for b in range(len(own)) if int(asked[a] ^ own[b]).bit_count() <= 15}
    assert set(zip(*(x.tolist() for x in wide.near(12, asked)))) == near and len(near) > 300


def bag(ws):
    """The shingles of one to five words with their numbers and weights, in plain Python."""
    out = {}
    for s in range(1, 6):
        for a in range(len(ws) - s + 1):
            part = tuple(ws[a : a + s])
            out[part] = (out.get(part, (0, 0))[0] + 1, sum(map(len, part)) / s**3)
    return out


def cosine(a, b):
    x, y = bag(a), bag(b)
    weight = lambda z: sum(n * w for n, w in z.values())
    return sum(min(n, y[k][0]) * w for k, (n, w) in x.items() if k in y) / (weight(x) * weight(y)) ** 0.5


def edited(rng, ws, edits, vocabulary):
    """ws with so many words replaced, dropped or added to."""
    out = list(ws)
    for p in sorted(rng.sample(range(len(ws)), edits), reverse=True):
        out[p : p + 1] = rng.choice([[rng.choice(vocabulary)], [], [out[p], rng.choice(vocabulary)]])
    return out


def test_near_windows_against_brute_force(spark):
    """Precision 1 by definition; of the pairs that brute force finds, 95 % at least."""
    rng = random.Random(11)
    vocabulary = [f"{c}{i}" * (1 + i % 3) for i in range(200) for c in "abc"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([18, 25, 33, 41])))) for i in range(25)]
    documents = [(d, " ".join(rng.choices(vocabulary, k=9) + edited(rng, words(rng.choice(items)[1]), rng.randrange(7), vocabulary) + rng.choices(vocabulary, k=9))) for d in range(80)]
    expected = {}
    for d, text in documents:
        own = words(text)
        for i, item in items:
            w = words(item)
            sims = [cosine(own[a : a + len(w)], w) for a in range(len(own) - len(w) + 1)]
            if max(sims, default=0) >= 0.8:
                expected[d, i] = (max(sims), sum(x >= 0.8 for x in sims))
    for blocks in (200_000, 100):  # one block of items, and many
        got = {(r.key, r.item): r for r in run(spark, documents, items, block_windows=blocks) if r.similarity is not None}
        assert set(got) <= set(expected) and len(got) >= 0.95 * len(expected) and len(expected) > 30
        assert all(r.similarity <= expected[k][0] + 1e-9 and r.near <= expected[k][1] for k, r in got.items())


def test_recall_of_planted_edits():
    """Items of 30 to 64 words planted with one to three words replaced, dropped or added to: 9 of 10 at least, for each number."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" * (1 + i % 2) for i in range(3000)]
    number = {w: rng.getrandbits(64) for w in vocabulary}
    arrays = lambda ws: (np.array([number[w] for w in ws], np.uint64), np.array([len(w) for w in ws], np.int64))
    items = [rng.choices(vocabulary, k=rng.randrange(30, 65)) for _ in range(150)]
    held = leak._Held([(i, *arrays(w)) for i, w in enumerate(items)], leak.WINDOW, leak.SHINGLE, leak.RADIUS, leak.NEAR_RADIUS, leak.SIMILARITY, True)
    for edits in (1, 2, 3):
        hits = 0
        for i, item in enumerate(items):
            text = rng.choices(vocabulary, k=25) + edited(rng, item, edits, vocabulary) + rng.choices(vocabulary, k=25)
            found = {}
            held.segment(*arrays(text), np.zeros(len(text), int), found)
            assert {k for _, k in found} <= {i}
            hits += found.get((0, i), [0, 0])[1] > 0
        assert hits >= 0.9 * len(items)


def test_long_items_and_long_words(spark):
    """An item over several blocks, a leaked part of it with an edit, and words of a thousand letters, whose length counts whole."""
    rng = random.Random(8)
    long = [f"v{i}" for i in range(900)]
    part = long[400:480]
    part[40] = "other"
    giant = ["q" * 1000] + [f"z{i}" for i in range(20)]
    documents = [(1, " ".join(part)), (2, " ".join(giant[1:] + ["tail"])), (3, " ".join(giant[:1] + rng.sample(giant[1:], 20)))]
    got = {(r.key, r.item): (r.copied, r.near > 0) for r in run(spark, documents, [(1, " ".join(long)), (2, " ".join(giant))], block_windows=200)}
    assert got == {(1, 1): (True, True), (2, 2): (True, False), (3, 2): (False, True)}
