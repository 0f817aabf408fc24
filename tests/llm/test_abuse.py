import itertools
import math

import numpy as np
import pytest

from rankspark.llm import abuse


def test_marginals_against_all_paths():
    rng = np.random.default_rng(8)
    chain = np.array([0] * 5 + [1] + [2] * 9 + [3] * 2)
    emission, steps = rng.normal(size=len(chain)) * 2, np.array([[0.0, -1.2], [-0.4, 0.7]])
    p, expected = abuse.marginals(emission, chain, steps)
    total = np.zeros((2, 2))
    for c in range(4):
        at = np.flatnonzero(chain == c)
        weights = {}
        for path in itertools.product((0, 1), repeat=len(at)):
            s = steps[0, path[0]] + sum(emission[i] * y for i, y in zip(at, path)) + sum(steps[a, b] for a, b in zip(path, path[1:]))
            weights[path] = math.exp(s)
        z = sum(weights.values())
        for k, i in enumerate(at):
            assert abs(p[i] - sum(w for y, w in weights.items() if y[k]) / z) < 1e-9
        for path, w in weights.items():
            for a, b in zip(path, path[1:]):
                total[a, b] += w / z
    assert np.allclose(total, expected)


def test_disguises():
    read = lambda t: [abuse.normal(m.group()) for m in abuse.TOKEN.finditer(t)]
    assert read("i.d.i.o.t, M O R O N sttttupid f00l p@nt13s f**l crétin") == ["idiot", "moron", "stupid", "fol", "panties", "f*l", "cretin"]
    assert read("30ml 250 g don't") == ["#ml", "#", "g", "don't"] and read("") == []
    assert abuse.normal("сlоwn") == "clown"  # with letters of another alphabet


INSULTS = ["you are a dumb clown", "get lost you pathetic fool", "shut up you worthless moron", "nobody likes you idiot"]
CLEAN = ["stir the soup for ten minutes", "this foolproof cake was lovely", "i felt like an idiot when i forgot the salt", "serve the pie with cream", "beat the eggs and whip the cream", "my oven runs hot so i wait"]


def judged(n=240):
    texts, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        body = [CLEAN[(i + k) % len(CLEAN)].capitalize() for k in range(3)]
        if bad:
            body.insert(i % 3, INSULTS[(i // 5) % len(INSULTS)].capitalize())
        texts.append(". ".join(body) + ".")
        marks.append(float(bad) if i % 29 else 1.0 - bad)  # raters err
    return texts, marks


def test_held_out_accuracy_and_offsets():
    texts, marks = judged()
    field = abuse.fit_judged(texts, marks)
    words = abuse.Words()
    for insult in ("YOU ARE A D.U.M.B CLOWN", "get lost you pathetiiiic fool", "nobody likes you 1d10t"):
        text = "Serve the pie with cream. " + insult + ". Stir the soup for ten minutes."
        score, spans = abuse.judge([text], field, words)[0]
        assert score >= abuse.THRESHOLD and all(26 <= a < b <= 26 + len(insult) for a, b in spans) and spans
    for text in CLEAN + ["", None, "...", "x " * 2000]:
        score, spans = abuse.judge([text], field, words)[0]
        assert score < abuse.THRESHOLD and spans == []


def test_tables(spark):
    """Nulls, empty texts and tables, repeated rows, disagreeing and unknown judgements, clashing columns, long texts."""
    texts, marks = judged()
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (901, ""), (None, "Stir."), (902, "word. " * 20_000 + "You are a dumb clown.")]
    documents = spark.createDataFrame([(*r, 1.0, "k") for r in rows], "doc_id long, text string, score double, key string")
    votes = [(i, 1, int(m)) for i, m in enumerate(marks)] + [(0, 1, 1), (0, 2, 0), (0, 3, 1), (555_555, 1, 1), (900, 1, 1), (3, 9, None)]
    labels = spark.createDataFrame([(*v, 5) for v in votes], "doc_id long, rater int, abusive int, share int")
    field = abuse.fit(documents, labels)
    got = abuse.score_documents(documents, field).collect()
    assert len(got) == len(rows)
    scores = {r.key: (r.score, r.spans) for r in got}
    assert scores[900] == scores[901] == (0.0, []) and scores[902][0] >= abuse.THRESHOLD and scores[902][1][0].start >= 120_000
    assert sum((scores[i][0] >= abuse.THRESHOLD) == (i % 5 == 0) for i in range(240)) >= 236
    nothing = abuse.fit(documents, labels.limit(0))
    assert abuse.score_documents(documents, nothing).filter("score >= 0.5").count() == 0
    assert abuse.score_documents(documents.limit(0), field).count() == 0
    assert abuse.fit(documents.limit(0), labels).weights.any() == False  # noqa: E712


@pytest.mark.parametrize("size", [1, 3, 7])
def test_small_batches_agree_with_large_ones(size):
    texts, marks = judged(60)
    field = abuse.fit_judged(texts, marks)
    whole = abuse.judge(texts, field, abuse.Words())
    parts = [x for a in range(0, 60, size) for x in abuse.judge(texts[a : a + size], field, abuse.Words())]
    assert [(round(s, 9), p) for s, p in whole] == [(round(s, 9), p) for s, p in parts]


def test_chains_of_any_length():
    """A sentence of 5,000 tokens is one chain; its marginals are those of the same recursion in plain Python."""
    tokens = abuse.read([" ".join(f"word{i}" for i in range(5000)), "Short one. Other"], abuse.Words())
    assert np.unique(tokens.chain, return_counts=True)[1].tolist() == [5000, 2, 1]
    rng = np.random.default_rng(5)
    emission, steps = rng.normal(0, 2, 5003), np.array([[0.0, -2.0], [-1.0, 0.5]])
    p, _ = abuse.marginals(emission, tokens.chain, steps)
    a, own = np.exp(steps), emission[:5000]
    e = np.stack([np.ones(5000), np.exp(own)], 1)
    f, b = np.zeros((5000, 2)), np.ones((5000, 2))
    f[0] = np.array([1.0, np.exp(steps[0, 1])]) * e[0]
    f[0] /= f[0].sum()
    for t in range(1, 5000):
        f[t] = (f[t - 1] @ a) * e[t]
        f[t] /= f[t].sum()
    for t in range(4998, -1, -1):
        b[t] = a @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    both = f * b
    assert np.allclose(p[:5000], both[:, 1] / both.sum(1), atol=1e-9)


def test_disguise_is_undone_by_form_alone():
    assert [abuse.normal(t) for t in ("s t u p i d", "1diot", "st0ve", "250g", "f**k", "STÜPIDDD", "2")] == ["stupid", "idiot", "stove", "#g", "f*k", "stupid", "#"]
