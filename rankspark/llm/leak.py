"""Evaluation texts inside a corpus: SimHash windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Two kinds of windows are looked for in the documents. Parts are windows of `window` words (the item's length if shorter):
equal words are a copied passage. Item-sized windows (windows of LONGEST words at every STRIDE of a longer item) are
compared by their shingles of one to five words: the weighted cosine decides what is nearly copied. A window's
fingerprint is the sign of the weighted sum of its shingles' 64-bit hashes, from running sums, so that each window size
costs one subtraction a word. Two fingerprints within `radius` bits are within radius div 4 bits in one of 4 blocks at
least, so the tables of the blocks, which hold every value that near, give all of them.

Documents stay where they are and are read once. Items are sent to them in blocks bounded by a parameter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, SHINGLE, RADIUS, SIMILARITY = 12, 5, 3, 0.8
#: Item-sized windows: their longest, the step between those of longer items, the radius of their fingerprints.
LONGEST, STRIDE, NEAR_RADIUS = 64, 8, 15
#: Most words of items that are held against the documents at once; more items take more turns.
BLOCK_WINDOWS = 200_000
#: Words of documents handled at once; bounds memory for texts of any length.
SEGMENT = 8192


def hashed_words(text: Column) -> tuple[Column, Column]:
    """64-bit hashes and lengths of the words (runs of a-z and 0-9 after lower-casing) of a text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w)), F.transform(words, lambda w: F.length(w))


def shingle_hashes(words: np.ndarray, lengths: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight (letters) of the shingle of s words at each position that has one."""
    n = len(words) - s + 1
    h, weight = np.full(n, 0x2545F4914F6CDD1D, np.uint64), np.zeros(n, np.int64)
    for i in range(s):
        h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        weight += lengths[i : i + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), weight


def shingle_weight(letters: np.ndarray, s: int) -> np.ndarray:
    """Weight of shingles of s words: letters / s^3, so that words count most and longer shingles say that they go together."""
    return letters / s**3


def running_sums(words: np.ndarray, lengths: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted signs of the 64 bits of all shingles that start before a place, and of all that end before it."""
    n = len(words)
    starts, ends = np.zeros((n + 1, 64), np.int32), np.zeros((n + 1, 64), np.int32)
    for s in sizes:
        if n < s:
            continue
        h, letters = shingle_hashes(words, lengths, s)
        # a fingerprint's vector has the root of a shingle's weight, so that its angle is that of the weighted cosine
        value = np.maximum(1, np.rint(64 * np.sqrt(shingle_weight(letters, s)))).astype(np.int32)  # sums of 2 GB of text fit
        signed = (2 * np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8) - 1) * value[:, None]
        starts[1 : n - s + 2] += signed
        if len(sizes) > 1:
            ends[s:] += signed
    before = np.cumsum(starts, axis=0, dtype=np.int32)
    if len(sizes) == 1:  # shingles of one size end in the order in which they start
        ends[sizes[0] :] = before[1 : n - sizes[0] + 2]
        return before, ends
    return before, np.cumsum(ends, axis=0, dtype=np.int32)


def fingerprints(sums: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """SimHash of each window of size words: what ends before its end and doesn't start before its start."""
    starts, ends = sums
    return np.packbits(ends[size:] > starts[:-size], axis=1).view(np.uint64).ravel()


def _masks(width: int, most: int) -> np.ndarray:
    """All numbers of `width` bits with at most `most` bits set."""
    return np.array([sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(width), k)], np.int64)


class Index:
    """Item windows by size, each with the block tables of their fingerprints. items: (number, words, letters of words)."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], window: int, shingle: int | tuple[int, ...], radius: int, stride: int = 1, least: int = 1):
        self.radius, self.sizes = radius, {}
        self.shingles = (shingle,) if isinstance(shingle, int) else tuple(shingle)
        count = min(radius + 1, 4)
        bounds = [round(64 * i / count) for i in range(count + 1)]
        self.blocks = [(a, b - a) for a, b in zip(bounds, bounds[1:])]
        if max(w for _, w in self.blocks) > 24:
            raise ValueError("the radius is too small for block tables; it must be 2 at least")
        by: dict[int, list] = {}
        for number, (_, words, lengths) in enumerate(items):
            if (size := min(window, len(words))) >= least:
                by.setdefault(size, []).append((number, words, lengths))
        for size, own in by.items():
            prints, rows, letters, owner = [], [], [], []
            for number, words, lengths in own:
                last = len(words) - size
                at = np.unique(np.append(np.arange(0, last + 1, stride), last))
                prints.append(fingerprints(running_sums(words, lengths, self.of(size)), size)[at])
                rows.append(np.lib.stride_tricks.sliding_window_view(words, size)[at])
                letters.append(np.lib.stride_tricks.sliding_window_view(lengths, size)[at])
                owner.append(np.full(len(at), number))
            prints_ = np.concatenate(prints)
            tables = []
            for at, width in self.blocks:
                value = ((prints_ >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
                near = (value[:, None] ^ _masks(width, radius // count)[None, :]).ravel()
                order = np.argsort(near, kind="stable")
                item = (order // (len(near) // max(1, len(value)))).astype(np.int32)
                tables.append((item, np.searchsorted(near[order], np.arange((1 << width) + 1)).astype(np.int32)))
            self.sizes[size] = (prints_, np.concatenate(rows), np.concatenate(letters), np.concatenate(owner), tables)

    def of(self, size: int) -> tuple[int, ...]:
        """The shingle sizes of a window: those that fit, else its own length."""
        return tuple(s for s in self.shingles if s <= size) or (size,)

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in prints, item window) within the radius, each once."""
        own, _, _, _, tables = self.sizes[size]
        pairs = []
        for (at, width), (table, starts) in zip(self.blocks, tables):
            value = ((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int32)
            first = starts[value]
            count = starts[value + 1] - first
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            count, first = count[hit].astype(np.int64), first[hit].astype(np.int64)
            position = np.repeat(hit, count)
            item = table[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
            close = np.bitwise_count(prints[position] ^ own[item]) <= self.radius
            pairs.append(position[close] * np.int64(len(own)) + item[close])
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        once = np.unique(np.concatenate(pairs))
        return once // len(own), once % len(own)


def shingle_bag(words: np.ndarray, lengths: np.ndarray, sizes: tuple[int, ...]) -> tuple[Counter, dict[int, float], float]:
    """The shingles of a window with their numbers, their weights, and the weight of all of them."""
    bag: Counter = Counter()
    weights: dict[int, float] = {}
    for s in sizes:
        h, letters = shingle_hashes(words, lengths, s)
        for x, w in zip(h.tolist(), shingle_weight(letters, s).tolist()):
            bag[x] += 1
            weights[x] = w
    return bag, weights, sum(n * weights[x] for x, n in bag.items())


def weighted_similarity(a: tuple[Counter, dict[int, float], float], b: tuple[Counter, dict[int, float], float]) -> float:
    """Weighted cosine of two windows: weight of the shingles in common over the root of the product of their weights."""
    common = sum(min(n, b[0][x]) * a[1][x] for x, n in a[0].items() if x in b[0])
    return common / max(1e-12, a[2] * b[2]) ** 0.5


class _Held:
    """A block of items, ready to be held against words of documents."""

    def __init__(self, items: list, window: int, shingle: int, radius: int, near_radius: int, similarity: float, near: bool):
        self.numbers, self.similarity = [i for i, _, _ in items], similarity
        self.parts = Index(items, window, shingle, radius)
        sizes = tuple(range(1, shingle + 1))
        self.whole = Index(items, max(window, LONGEST), sizes, near_radius, STRIDE, shingle) if near else None
        self.reach = max([*self.parts.sizes, *(self.whole.sizes if near else ())], default=1) - 1
        self.known = {size: [np.unique(r) for r in rows] for size, (_, rows, _, _, _) in self.whole.sizes.items()} if near else {}
        self.bags: dict[tuple[int, int], tuple] = {}

    def segment(self, words: np.ndarray, lengths: np.ndarray, document: np.ndarray, found: dict) -> None:
        """Adds to found[(document, item)] = [equal windows, near windows, best similarity]."""
        for kind, index in enumerate((self.parts, self.whole)):
            sums: dict = {}
            for size in index.sizes if index else ():
                if len(words) < size:
                    continue
                if (s := index.of(size)) not in sums:
                    sums[s] = running_sums(words, lengths, s)
                inside = np.flatnonzero(document[: len(words) - size + 1] == document[size - 1 :])
                inside = inside[inside < SEGMENT]  # later ones start in the next segment
                at, item = index.near(size, fingerprints(sums[s], size)[inside])
                if not len(at):
                    continue
                at, rows, owner = inside[at], index.sizes[size][1], index.sizes[size][3]
                if kind == 0:
                    same = (np.lib.stride_tricks.sliding_window_view(words, size)[at] == rows[item]).all(axis=1)
                    key = document[at[same]].astype(np.int64) * len(self.numbers) + owner[item[same]]
                    for k, n in zip(*(x.tolist() for x in np.unique(key, return_counts=True))):
                        found.setdefault(divmod(k, len(self.numbers)), [0, 0, 0.0])[0] += n
                else:
                    for p, i, sim in self._similar(size, words, lengths, at, item):
                        entry = found.setdefault((int(document[p]), int(owner[i])), [0, 0, 0.0])
                        entry[1] += 1
                        entry[2] = max(entry[2], sim)

    def _similar(self, size: int, words: np.ndarray, lengths: np.ndarray, at: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """The pairs whose similarity is reached; a bound, from words that both windows have, spares most exact comparisons."""
        own, own_words, sizes = self.whole.sizes[size], np.lib.stride_tricks.sliding_window_view(words, size), self.whole.of(size)
        own_lengths = np.lib.stride_tricks.sliding_window_view(lengths, size)
        for i in np.unique(item).tolist():
            places = at[item == i]
            mine, known = own_words[places], self.known[size][i]
            place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            shared, letters = known[place] == mine, own_lengths[places]
            common, total = np.zeros(len(places)), np.zeros(len(places))
            both, sums = shared, letters
            for s in range(1, max(sizes) + 1):
                if s > 1:
                    both = both[:, :-1] & shared[:, s - 1 :]
                    sums = sums[:, :-1] + letters[:, s - 1 :]
                weight = shingle_weight(sums, s)
                common += (weight * both).sum(1)
                total += weight.sum(1)
            if (size, i) not in self.bags:
                self.bags[size, i] = shingle_bag(own[1][i], own[2][i], sizes)
            bag = self.bags[size, i]
            for p in places[common >= (self.similarity - 1e-9) * np.sqrt(total * bag[2])].tolist():
                sim = weighted_similarity(shingle_bag(words[p : p + size], lengths[p : p + size], sizes), bag)
                if sim >= self.similarity:
                    yield p, i, min(1.0, sim)


def _scan(blocks: list, how: tuple):
    """Every batch is held against every block; with several blocks, batches are gathered so that a block is prepared seldom."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}

        def held(number: int) -> _Held:
            if number not in made:
                made.clear()
                made[number] = _Held(blocks[number].value, *how)
            return made[number]

        def results(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[dict] = [{} for _ in group]
            for number in range(len(blocks)):
                block = held(number)
                for batch, seen in zip(group, found):
                    words = batch.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    lengths = batch.column("lengths").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    document = np.repeat(np.arange(batch.num_rows), batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    here: dict = {}
                    for a in range(0, len(words), SEGMENT):
                        part = slice(a, a + SEGMENT + block.reach)
                        block.segment(words[part], lengths[part], document[part], here)
                    for (d, i), (copies, near, best) in here.items():  # a long item may lie in several blocks
                        old = seen.setdefault((d, block.numbers[i]), [0, 0, 0.0])
                        seen[d, block.numbers[i]] = [old[0] + copies, old[1] + near, max(old[2], best)]
            for batch, seen in zip(group, found):
                keys = list(seen)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array([d for d, _ in keys], pa.int64())), pa.array([i for _, i in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int32()),
                        pa.array([seen[k][1] for k in keys], pa.int32()), pa.array([seen[k][0] > 0 for k in keys], pa.bool_()), pa.array([seen[k][2] or None for k in keys], pa.float64()),
                    ],
                    names=["key", "item", "windows", "near", "copied", "similarity"],
                )

        group: list[pa.RecordBatch] = []
        for batch in batches:
            group.append(batch)
            if len(blocks) == 1 or sum(b.nbytes for b in group) > 64 << 20:
                yield from results(group)
                group = []
        if group:
            yield from results(group)

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
    radius: int = RADIUS, similarity: float = SIMILARITY, block_windows: int = BLOCK_WINDOWS, near: bool = True, near_radius: int = NEAR_RADIUS,
) -> DataFrame:
    """(key, item, windows, near, copied, similarity): the items that leak into each document.

    windows: pairs of a window of the document and one of the item, of `window` words (the item's length if it is shorter),
    that are equal; copied: whether there is one. near: pairs of item-sized windows whose fingerprints are within
    `near_radius` bits and whose weighted cosine over shingles of one to `shingle` words is `similarity` or more (items of
    fewer words are found as copies only); similarity: the best of them, null if there is none. near=False leaves
    these out. Texts that are null or without words leak nothing and have nothing leaked; keys and items may be null;
    repeated rows of items count once, a repeated row of documents comes out again; an empty table on either side gives
    no row; texts of any length are taken whole; other columns don't matter.
    """
    hashes, lengths = hashed_words(F.col(item_text))
    asked = items.select(F.col(item).cast("bigint").alias("item"), hashes.alias("words"), lengths.alias("lengths")).filter(F.size("words") > 0).distinct()
    own_hashes, own_lengths = hashed_words(F.col(text))
    rows = documents.select(F.col(key).cast("bigint").alias("key"), own_hashes.alias("words"), own_lengths.alias("lengths")).filter(F.size("words") > 0)
    context = documents.sparkSession.sparkContext
    blocks, block, size = [], [], 0
    step = max(STRIDE, block_windows // STRIDE * STRIDE)

    def flush() -> None:
        if block:
            blocks.append(context.broadcast(list(block)))  # its size is bounded by block_windows
            block.clear()

    for number, words, letters in asked.toLocalIterator():  # the items one by one; the corpus is never collected
        words_, letters_ = np.array(words, np.int64).view(np.uint64), np.array(letters, np.int64)
        for a in range(0, max(1, len(words_) - LONGEST + 1), step):  # a very long item lies in several blocks
            end = len(words_) if a + step > len(words_) - LONGEST else a + step + LONGEST - STRIDE
            if size + end - a > block_windows:
                flush()
                size = 0
            block.append((number, words_[a:end], letters_[a:end]))
            size += end - a
    flush()
    schema = "key bigint, item bigint, windows int, near int, copied boolean, similarity double"
    if not blocks:
        return documents.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_scan(blocks, (window, shingle, radius, near_radius, similarity, near)), schema)
