"""Abusive, hateful or sexual content: a linear-chain conditional random field over disguised and plain tokens.

Judgements are of whole documents. The tokens of a judged document get their labels from them: none is offending in a
document judged clean; in one judged abusive, the sentences that tell it from clean ones are, first by log-odds of their
words, then, in turns with training, by the field itself. The trained field gives every token of the corpus its marginal
by forward-backward; runs of likely tokens are the offending spans, and the likeliest stretch is the document's score.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most judged documents that the field is fitted on (those of the least hash of their id); the corpus is scored whole.
MAX_JUDGED = 6_000
HASH_BITS = 18
THRESHOLD = 0.5
#: Most cells (chains by their longest length) that forward-backward handles at once; bounds memory, not chains.
CELLS = 2_000_000

#: Pronouns that address someone, and those of the writer, in four languages. Fixed values.
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch tu te ton ta toi vous tes ti tuyo vete eres callate".split())
FIRST = frozenset("i me my myself mine we our us im ich mich mir mein meine je moi mon ma mes yo mi mis".split())
#: Signs that stand for letters, and look-alikes of other alphabets. Fixed values.
LEET = str.maketrans("013457@$!", "oieastasi")
ALIKE = str.maketrans("авеёкмнорстухіјѕԁѵαβεικνορτυχ", "abeekmhopctyxijsdvabeikvoptux")

SPACED = r"(?<![^\W_])[^\W\d_]([ .\-_·])[^\W\d_](?:\1[^\W\d_])+(?![^\W_])"
PLAIN = r"[@$]?[^\W_](?:[\w@$'’]|\*+(?=\w)|\*{2,}|!(?=\w))*"
TOKEN = re.compile(f"{SPACED}|{PLAIN}")
ENDS = re.compile(r"[.!?…\n\r¡¿。！？]")


def normal(token: str) -> str:
    """A token without case, accents, repeats of letters and disguise, by its own form only.

    Letters set apart are put together; masked letters become one star between the first and the last; signs and digits
    among letters, and look-alikes among Latin letters, become the letters they stand for; a number before letters is one sign.
    """
    t = unicodedata.normalize("NFKD", token.lower())
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").replace("’", "'").strip("'")
    if re.fullmatch(SPACED, t):
        t = re.sub(r"[ .\-_·]", "", t).translate(ALIKE)
    elif "*" in t:
        return t[:1] + "*" + (t[-1] if t[-1] != "*" else "")
    elif t.isdigit():
        return "#"
    elif t[:1].isdigit() and not re.fullmatch(r"[013457][^\W\d_]{3,}", t):
        return "#" + t.lstrip("0123456789")
    elif any(c in "013457@$!" for c in t):
        t = t.translate(LEET)
    if not t.isascii() and any(c.isascii() and c.isalpha() for c in t):
        t = t.translate(ALIKE)
    return re.sub(r"(.)\1+", r"\1", t)


class Words:
    """Numbers and classes of tokens: bit 1 second person, 2 first person, 3 masked. Remembers what it has seen."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple[int, int]] = {}

    def __call__(self, token: str) -> tuple[int, int]:
        known = self.seen.get(token)
        if known is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            n = normal(token)
            kind = (n in SECOND) << 1 | (n in FIRST) << 2 | ("*" in n) << 3
            known = self.seen[token] = (zlib.crc32(n.encode("utf-8", "surrogatepass")) | 1, kind)
        return known


@dataclass
class Tokens:
    """Tokens of several texts, flat: number, class, text, place in it, and the chain (a sentence, of any length)."""

    ids: np.ndarray
    kinds: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    chain: np.ndarray


def read(texts: list[str | None], words: Words) -> Tokens:
    ids, kinds, own, starts, ends, chains = [], [], [], [], [], []
    chain = -1
    for i, text in enumerate(texts):
        last = None
        for m in TOKEN.finditer(text or ""):
            a, b = m.span()
            if last is None or ENDS.search(text, last, a):
                chain += 1
            last = b
            n, k = words(m.group())
            ids.append(n), kinds.append(k), own.append(i), starts.append(a), ends.append(b), chains.append(chain)
    make = lambda x, t: np.array(x, dtype=t)
    return Tokens(make(ids, np.uint32), make(kinds, np.uint8), make(own, np.int32), make(starts, np.int32), make(ends, np.int32), make(chains, np.int32))


def features(tokens: Tokens) -> np.ndarray:
    """Hashed features of each token (rows): itself, neighbours within its chain, pairs and triples, and the classes around it."""
    n = len(tokens.ids)
    w = tokens.ids.astype(np.uint64)

    def near(values: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros_like(values)
        if d > 0:
            out[:-d] = np.where(tokens.chain[d:] == tokens.chain[:-d], values[d:], 0)
        elif d < 0:
            out[-d:] = np.where(tokens.chain[:d] == tokens.chain[-d:], values[:d], 0)
        return out

    if n < 5:  # shifts need some length; pad with chains of their own
        pad = 5
        more = Tokens(*[np.concatenate([x, np.full(pad, -1 if name == "chain" else 0, x.dtype)]) for name, x in vars(tokens).items()])
        return features(more)[:n]
    w1, w2, v1, v2 = near(w, -1), near(w, -2), near(w, 1), near(w, 2)
    around = tokens.kinds.copy()
    for d in (-4, -3, -2, -1, 1, 2, 3, 4):
        around |= near(tokens.kinds, d)
    kind = tokens.kinds.astype(np.uint64)
    mixed = [w, w1, v1, w2, v2, w1 * np.uint64(31) + w, w * np.uint64(31) + v1, w1 * np.uint64(37) + v1, w2 * np.uint64(41) + w1 * np.uint64(31) + w, w * np.uint64(41) + v1 * np.uint64(31) + v2, kind, kind * np.uint64(16) + around.astype(np.uint64)]
    out = np.empty((n, len(mixed)), np.int32)
    for i, x in enumerate(mixed):
        x = (x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, i] = (x >> np.uint64(64 - HASH_BITS)).astype(np.int32)
    return out


@dataclass
class Field:
    """Weights of features for an offending token, and log-weights of (previous, next) states."""

    weights: np.ndarray
    steps: np.ndarray


def _chains(chain: np.ndarray) -> Iterator[np.ndarray]:
    """Chains of about equal length together: positions of their tokens, one row a chain, -1 after its end."""
    if not len(chain):
        return
    starts = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(chain)]]))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = max(int(sizes[order[at]] * 1.3) + 2, 8)
        stop = int(np.searchsorted(sizes[order], longest, side="right"))
        stop = min(max(stop, at + 1), at + max(1, CELLS // longest))
        own = order[at:stop]
        grid = starts[own][:, None] + np.arange(sizes[own].max())[None, :]
        yield np.where(np.arange(grid.shape[1])[None, :] < sizes[own][:, None], grid, -1)
        at = stop


def marginals(emission: np.ndarray, chain: np.ndarray, steps: np.ndarray, grids: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(offending) of every token by forward-backward, and the expected numbers of steps between states. grids: those of _chains(), if at hand."""
    p, expected = np.zeros(len(emission)), np.zeros((2, 2))
    a = np.exp(steps)
    for grid in _chains(chain) if grids is None else grids:
        real = grid >= 0
        rows, length = grid.shape
        e = np.ones((rows, length, 2))
        e[:, :, 1] = np.where(real, np.exp(np.clip(emission[grid], -30, 30)), 1.0)
        forward, back = np.empty((rows, length, 2)), np.empty((rows, length, 2))
        f = np.array([1.0, math.exp(steps[0, 1])]) * e[:, 0]
        forward[:, 0] = f / f.sum(1, keepdims=True)
        for t in range(1, length):
            f = (forward[:, t - 1] @ a) * e[:, t]
            forward[:, t] = np.where(real[:, t, None], f / f.sum(1, keepdims=True), forward[:, t - 1])
        back[:, -1] = 1.0
        for t in range(length - 2, -1, -1):
            b = (e[:, t + 1] * back[:, t + 1]) @ a.T
            back[:, t] = np.where(real[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
        both = forward * back
        both /= both.sum(2, keepdims=True)
        p[grid[real]] = both[:, :, 1][real]
        if length > 1:
            x = forward[:, :-1, :, None] * a[None, None] * (e[:, 1:] * back[:, 1:])[:, :, None, :]
            x /= x.sum((2, 3), keepdims=True)
            expected += (x * real[:, 1:, None, None]).sum((0, 1))
    return p, expected


def fit_field(tokens: Tokens, labels: np.ndarray, weight: np.ndarray, rounds: int = 40, rate: float = 0.5, decay: float = 2e-4, start: Field | None = None) -> Field:
    """Maximum likelihood of labelled tokens by adaptive gradient steps over all of them. weight: of each token's chain."""
    x = features(tokens)
    field = start or Field(np.zeros(1 << HASH_BITS), np.array([[0.0, -3.0], [-1.0, 1.0]]))
    theta, steps = field.weights.copy(), field.steps.copy()
    g2, s2 = np.full(len(theta), 1e-3), np.full((2, 2), 1.0)
    inside = np.flatnonzero((tokens.chain[1:] == tokens.chain[:-1]))
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[inside], labels[inside + 1]), 1)
    flat, grids = x.ravel(), list(_chains(tokens.chain))
    for _ in range(rounds):
        p, expected = marginals(theta.astype(np.float32)[x].sum(1), tokens.chain, steps, grids)
        gradient = np.bincount(flat, np.repeat(((labels - p) * weight).astype(np.float32), x.shape[1]), minlength=len(theta)) - decay * len(labels) * 0.01 * theta
        g2 += gradient**2
        theta += rate * gradient / np.sqrt(g2)
        gs = seen - expected
        s2 += gs**2
        steps += 0.3 * gs / np.sqrt(s2)
        steps[0, 0] = 0.0
    return Field(theta, steps)


def chain_scores(p: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """For each chain, the highest mean of three neighbouring marginals (of all, if it has fewer)."""
    if not len(p):
        return np.zeros(0)
    starts = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(chain)]]))
    mean = np.add.reduceat(p, starts) / sizes
    threes = np.zeros(len(p))
    if len(p) >= 3:
        threes[:-2] = np.where(chain[2:] == chain[:-2], (p[:-2] + p[1:-1] + p[2:]) / 3, 0)
    return np.maximum(mean, np.maximum.reduceat(threes, starts))


def grams(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The word, and the pair with the next word of the chain (0 where there is none), at each token."""
    one = tokens.ids.astype(np.uint64)
    two = np.zeros(len(one), np.uint64)
    if len(one) > 1:
        two[:-1] = np.where(tokens.chain[1:] == tokens.chain[:-1], (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] << np.uint64(20)), 0)
    return one, two


def gram_counts(tokens: Tokens, wanted: np.ndarray) -> np.ndarray:
    """In how many of the texts each of the wanted (sorted) words and pairs occurs."""
    counts = np.zeros(len(wanted), np.int64)
    for kind in grams(tokens):
        at = np.minimum(np.searchsorted(wanted, kind), max(0, len(wanted) - 1))
        hit = wanted[at] == kind if len(wanted) else np.zeros(len(kind), bool)
        once = np.unique(at[hit].astype(np.int64) * (int(tokens.text.max(initial=0)) + 1) + tokens.text[hit])
        counts += np.bincount(once // (int(tokens.text.max(initial=0)) + 1), minlength=len(wanted))
    return counts


def wanted_grams(texts: list[str], judged: list[float]) -> np.ndarray:
    """The words and pairs of texts judged abusive, sorted."""
    one, two = grams(read([t for t, j in zip(texts, judged) if j >= 0.5], Words()))
    return np.unique(np.concatenate([one, two[two > 0]]))


def fit_judged(texts: list[str], judged: list[float], usual: tuple[np.ndarray, int] | None = None, turns: int = 3) -> Field:
    """A field from texts and the share of raters who judged each abusive; without judgements of both kinds, it says 0.

    usual: for wanted_grams() of these, in how many texts of the corpus they occur, and how many texts that has; by
    default the clean texts stand for the corpus.
    """
    tokens = read(texts, Words())
    abusive = np.array([j >= 0.5 for j in judged], bool)
    if not len(tokens.ids) or not abusive.any() or abusive.all():
        return Field(np.zeros(1 << HASH_BITS), np.array([[0.0, -30.0], [0.0, 0.0]]))
    wanted = wanted_grams(texts, judged)
    if usual is None:
        usual = gram_counts(read([t for t, j in zip(texts, judged) if j < 0.5], Words()), wanted), int((~abusive).sum())
    own = gram_counts(read([t for t, j in zip(texts, judged) if j >= 0.5], Words()), wanted)
    expected = usual[0] * abusive.sum() / max(1, usual[1])
    starts = np.flatnonzero(np.concatenate([[True], tokens.chain[1:] != tokens.chain[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(tokens.chain)]]))
    owner = tokens.text[starts]

    def surprise(without: int) -> np.ndarray:
        """Mean over a chain's words and pairs of log((seen + 0.5) / (expected + 0.5)) in abusive texts, `without` this one."""
        total, number = np.zeros(len(starts)), np.zeros(len(starts))
        for kind in grams(tokens):
            at = np.minimum(np.searchsorted(wanted, kind), len(wanted) - 1)
            known = (wanted[at] == kind) & (kind > 0)
            seen = np.where(known, own[at], 0) - np.where(known & abusive[tokens.text], without, 0)
            value = np.log((seen + 0.5) / (np.where(known, expected[at], 0) + 0.5))
            total += np.add.reduceat(np.where(kind > 0, value, 0.0), starts)
            number += np.add.reduceat((kind > 0).astype(float), starts)
        return total / (number + 1.0)

    others, all_ = surprise(1), surprise(0)
    clean = ~abusive[owner]
    cut = max(0.5, float(np.quantile(others[clean], 0.995)))
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, all_)
    found = np.zeros(len(texts), bool)
    hit = ~clean & (others >= cut)
    found[owner[hit]] = True
    hit |= ~clean & ~found[owner] & (all_ >= best[owner] - 1e-12) & (all_ >= 0.6)
    field, trust = None, np.where(clean, 1.0, np.where(hit, 1.0, 0.5))
    for turn in range(turns):
        labels = np.repeat(hit, sizes).astype(np.int64)
        field = fit_field(tokens, labels, np.repeat(trust, sizes))
        if turn == turns - 1:
            break
        p, _ = marginals(field.weights[features(tokens)].sum(1), tokens.chain, field.steps)
        likely = chain_scores(p, tokens.chain)
        # a sentence of a clean text that looks offending may be a rater's error; an abusive text has one that stands out
        np.maximum.at(best := np.zeros(len(texts)), owner, likely)
        hit = ~clean & ((likely >= 0.5) | ((best[owner] < 0.5) & (likely >= best[owner] - 1e-12) & (all_ >= 0.6)))
        trust = np.where(clean, np.where(likely > 0.9, 0.05, 1.0), np.where(hit, 1.0, 0.5))
    return field


def _count(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, texts = Words(), np.zeros(len(wanted), np.int64), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500).column("text").to_pylist()
                counts += gram_counts(read(part, words), wanted)
                texts += len(part)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[texts], counts[some]]))], names=["gram", "texts"])

    return run


def corpus_counts(documents: DataFrame, wanted: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each of the wanted words and pairs occurs, and how many documents there are; over all of them."""
    rows = documents.select(F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    sums = rows.mapInArrow(_count(wanted), "gram bigint, texts bigint").groupBy("gram").agg(F.sum("texts").alias("texts"))
    counts, number = np.zeros(len(wanted), np.int64), 0
    for gram, n in sums.toLocalIterator():  # one row per wanted gram, which the bounded sample bounds
        if gram < 0:
            number = n
        else:
            counts[gram] = n
    return counts, number


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_judged: int = MAX_JUDGED) -> Field:
    """The field from judgements labels(key, rater, abusive) of documents: at most max_judged of them, least key hash first.

    Null judgements and judgements of unknown or null texts don't count; a rater's repeated judgement counts once.
    """
    votes = labels.filter(F.col("abusive").isNotNull()).select(key, "rater", "abusive").distinct().groupBy(key).agg(F.avg("abusive").alias("share"))
    rows = documents.select(key, text).filter(F.col(text).isNotNull()).join(votes, key).orderBy(F.xxhash64(key), key).select(text, "share").limit(max_judged).collect()
    texts, judged = [r[0] for r in rows], [float(r[1]) for r in rows]
    wanted = wanted_grams(texts, judged) if texts else np.zeros(0, np.uint64)
    return fit_judged(texts, judged, corpus_counts(documents, wanted, text) if len(wanted) else None)


def judge(texts: list[str | None], field: Field, words: Words) -> list[tuple[float, list[tuple[int, int]]]]:
    """(score, spans) of each text; spans are (start, end) in code points."""
    tokens = read(texts, words)
    out: list[tuple[float, list[tuple[int, int]]]] = [(0.0, []) for _ in texts]
    if not len(tokens.ids):
        return out
    p, _ = marginals(field.weights[features(tokens)].sum(1), tokens.chain, field.steps)
    scores = chain_scores(p, tokens.chain)
    starts = np.flatnonzero(np.concatenate([[True], tokens.chain[1:] != tokens.chain[:-1]]))
    best = np.zeros(len(texts))
    np.maximum.at(best, tokens.text[starts], scores)
    hot = p >= 0.5
    edge = np.flatnonzero(hot & np.concatenate([[True], ~hot[:-1] | (tokens.chain[1:] != tokens.chain[:-1])]))
    stop = np.flatnonzero(hot & np.concatenate([~hot[1:] | (tokens.chain[1:] != tokens.chain[:-1]), [True]]))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(edge.tolist(), stop.tolist()):
        spans[tokens.text[a]].append((int(tokens.start[a]), int(tokens.end[b])))
    return [(float(best[i]), spans[i]) for i in range(len(texts))]


def _judge(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                said = judge(batch.column("text").to_pylist(), field, words)
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in said], kind)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([s for s, _ in said], pa.float64()), spans], names=["key", "score", "spans"])

    return run


def score_documents(documents: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score from 0 to 1, spans array<start, end>): every row of documents judged by the field.

    Null, empty and wordless texts score 0; texts of any length are read whole; repeated rows come out again; an empty
    table gives no row; other columns don't matter. Whether anything is abusive is a matter of THRESHOLD.
    """
    small = Field(field.weights.astype(np.float32), field.steps)
    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_judge(small), "key bigint, score double, spans array<struct<start:int,end:int>>")
