"""Near-duplicate records with small edits: circulant MinHash, banding, exact Jaccard.

Records of equal word sets are one class from the start, so copies never meet in a band. All coordinates of a class's
signature come from two permutations of the 32-bit integers: coordinate k is the least of pi(sigma(word) + k mod 2^32),
sigma spreading the words and pi, always the same, seeing them circularly shifted. Bands of coordinates are joined on
their hash, bands that many sets share part by part; two bounds that can't lose a pair (set sizes, and the symmetric
difference seen in a 128-bit bitmap) thin the candidates, and the exact Jaccard similarity of the word sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.session import use_checkpoints

#: 80 bands of 6 coordinates miss a pair of similarity 0.7 with probability 5e-5, one of 0.8 with 4e-11.
BANDS, ROWS = 80, 6
#: Bands are hot from about HOT sets on, as one set of SAMPLE shows; their parts have about PART sets each.
SAMPLE, HOT, PART = 16, 512, 4096
#: A list of hot bands is broadcast up to so many rows (16 bytes each), else joined by sorting.
BROADCAST_ROWS = 1_000_000


def word_set(*texts: Column) -> Column:
    """The distinct words (runs of a-z and 0-9 after lower-casing) of several texts, sorted; null texts are empty."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("[a-z0-9]+"), F.lit(0))))


def _mix(x: np.ndarray, a: int, b: int, s: tuple[int, int, int]) -> np.ndarray:
    """A permutation of the 32-bit integers: each step can be undone."""
    x = x ^ (x >> np.uint32(s[0]))
    x = x * np.uint32(a)
    x ^= x >> np.uint32(s[1])
    x *= np.uint32(b)
    x ^= x >> np.uint32(s[2])
    return x


def sigma(x: np.ndarray) -> np.ndarray:
    return _mix(x, 0x9E3779B1, 0x85EBCA77, (15, 13, 16))


def pi(x: np.ndarray) -> np.ndarray:
    return _mix(x, 0x7FEB352D, 0x846CA68B, (16, 15, 16))


def signatures(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates (rows) of each set (columns); sets are runs of `hashes` (uint32), none empty, from `starts`."""
    spread = sigma(hashes)
    out = np.empty((k, len(starts)), np.uint32)
    for i in range(k):
        out[i] = np.minimum.reduceat(pi(spread + np.uint32(i)), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band (rows of the result) and set."""
    keys = np.empty((bands, signature.shape[1]), np.uint64)
    for b in range(bands):
        key = np.full(signature.shape[1], b + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = (key ^ signature[b * rows + r].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
        keys[b] = key
    return keys


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                low, _, _, starts = _flat(batch)
                keys = band_keys(signatures(low, starts, bands * rows), bands, rows)
                ids = batch.column("set_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(ids, bands))], names=["band", "set_id"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Low and high halves of the words' hashes, the sizes of the sets, and where each begins."""
    words = batch.column("hashes")
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32), flat >> np.uint64(32), sizes, starts


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and 128-bit bitmap of each set."""
    for batch in batches:
        if batch.num_rows:
            _, high, sizes, starts = _flat(batch)
            bit, first = np.uint64(1) << (high & np.uint64(63)), (high >> np.uint64(6)) & np.uint64(1) == 0
            maps = [pa.array(np.bitwise_or.reduceat(np.where(half, bit, np.uint64(0)), starts).view(np.int64)) for half in (first, ~first)]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(sizes.astype(np.int32)), *maps], names=["set_id", "n", "map0", "map1"])


def _near(threshold: float) -> Column:
    """What any pair (a, b) of similarity threshold or more satisfies: close sizes, and bitmaps that differ little.

    |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|) wherever the similarity is t or more; the bitmaps show at most |A xor B|.
    """
    apart = F.bit_count(F.col("a.map0").bitwiseXOR(F.col("b.map0"))) + F.bit_count(F.col("a.map1").bitwiseXOR(F.col("b.map1")))
    return (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * (threshold - 1e-9)) & (apart <= (F.col("a.n") + F.col("b.n")) * ((1 - threshold) / (1 + threshold) + 1e-9))


def _hot_bands(hashed: DataFrame, bands: int, rows: int) -> DataFrame | None:
    """(band, parts) of the bands that many sets share, seen in one set of SAMPLE; None if there are none.

    Which bands are hot only says how they are joined, so a sample will do: no pair depends on it.
    """
    some = hashed.filter(F.pmod(F.xxhash64("set_id"), F.lit(SAMPLE)) == 0).mapInArrow(_bands(bands, rows), "band bigint, set_id bigint")
    parts = F.ceil(F.col("count") * SAMPLE / PART).cast("int").alias("parts")
    hot = some.groupBy("band").count().filter(F.col("count") * SAMPLE >= HOT).select("band", parts).checkpoint()
    return hot if hot.limit(1).count() else None


def _hot_pairs(keyed: DataFrame, hot: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs within hot bands: each band is cut into parts, and every two parts meet in a task of their own.

    The bound on sizes and bitmaps is part of the join's condition, so that a band's pairs aren't all written.
    """
    marked = keyed.join(hot, "band").join(sketches, "set_id")
    own = F.pmod(F.xxhash64("set_id", "band"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    spread = marked.withColumn("own", own).select("band", "set_id", "n", "map0", "map1", "own", other)
    spread = spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other")
    a, b = spread.hint("merge").alias("a"), spread.hint("merge").alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    return a.join(b, same & (F.col("a.set_id") < F.col("b.set_id")) & _near(threshold)).select(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b"))


def similar_sets(sets: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(set_a, set_b, similarity), set_a < set_b: pairs of sets(set_id bigint, words) with Jaccard similarity >= threshold.

    Words must be distinct within a set; empty sets have no partner. No bucket and no set has a limit of partners. Banded
    rows are a key and a set's number; they are never broadcast, as the planner can't see how many a set has.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    own = sets.filter(F.size("words") > 0)
    hashed = own.select("set_id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    keyed = hashed.mapInArrow(_bands(bands, rows), "band bigint, set_id bigint")
    sketches = hashed.mapInArrow(_sketches, "set_id bigint, n int, map0 bigint, map1 bigint")
    hot = _hot_bands(hashed, bands, rows)
    if hot is not None:
        few = hot.count() <= BROADCAST_ROWS
        hot = F.broadcast(hot) if few else hot.hint("merge")
    cold = keyed if hot is None else keyed.join(hot, "band", "left_anti")
    a, b = cold.hint("merge").alias("a"), cold.hint("merge").alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.set_id") < F.col("b.set_id"))).select(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b"))
    if hot is not None:
        pairs = pairs.unionByName(_hot_pairs(keyed, hot, sketches, threshold))
    at = lambda side: sketches.select(F.col("set_id").alias(f"set_{side}"), F.struct("n", "map0", "map1").alias(side))
    pairs = pairs.distinct().join(at("a"), "set_a").join(at("b"), "set_b").filter(_near(threshold)).select("set_a", "set_b")
    words_a = own.select(F.col("set_id").alias("set_a"), F.col("words").alias("words_a"))
    words_b = own.select(F.col("set_id").alias("set_b"), F.col("words").alias("words_b"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    exact = pairs.join(words_a, "set_a").join(words_b, "set_b").withColumn("both", both)
    exact = exact.select("set_a", "set_b", (F.col("both") / (F.size("words_a") + F.size("words_b") - F.col("both"))).alias("similarity"))
    return exact.filter(F.col("similarity") >= threshold)


def word_classes(records: DataFrame, key: str, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members(key, set_id), sets(set_id, words)): records by their word set, whose 64-bit hash is its id; checkpointed.

    Rows without words and with a null key are left out; a key with several contents is a member of several sets.
    """
    use_checkpoints(records.sparkSession)
    words = F.array_join(word_set(*[F.col(t) for t in texts]), " ")
    base = records.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), words.alias("words")).filter("words <> ''")
    base = base.withColumn("set_id", F.xxhash64("words")).checkpoint()  # texts are cut into words once
    sets = base.select("set_id", "words").distinct().checkpoint()
    return base.select("key", "set_id").distinct(), sets.select("set_id", F.split("words", " ").alias("words"))


def similar_pairs(records: DataFrame, key: str, texts: list[str], threshold: float = 0.7, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every pair of different keys whose word sets have Jaccard similarity >= threshold.

    The word set of a record is that of its text columns together, null as empty; a record without words, or with a null
    key, has no partner. Repeated rows count once; of a key with several contents, the words of all of them count. An
    empty table gives no row; other columns don't matter. Equal texts are found as one class and written as pairs at the
    end, as the columns of the result demand.
    """
    members, sets = word_classes(records, key, texts)
    links = similar_sets(sets, threshold, bands, rows).select("set_a", "set_b")
    twins = members.groupBy("set_id").agg(F.count("*").alias("c")).filter("c > 1")
    everyone = links.unionByName(twins.select(F.col("set_id").alias("set_a"), F.col("set_id").alias("set_b")))
    left, right = members.select(F.col("set_id").alias("set_a"), F.col("key").alias("x")), members.select(F.col("set_id").alias("set_b"), F.col("key").alias("y"))
    pairs = everyone.join(left, "set_a").join(right, "set_b").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, class_id): the connected components of edges(a, b), class_id being the least id; alternating stars.

    Each round points every node at the least of its neighbourhood; rounds grow with the logarithm of a component's
    size. The lineage is cut by checkpoint() in every round.
    """
    use_checkpoints(edges.sparkSession)

    def star(current: DataFrame, large: bool) -> DataFrame:
        if large:
            ends = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            ends = current.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = ends.join(least, "u")
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    current = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    seen = None
    while True:
        current = star(star(current, True), False).checkpoint()
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("class_id")).unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("class_id")).distinct())
        seen = mark


def duplicate_classes(records: DataFrame, key: str, texts: list[str], threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, class_id, copies, links): one row per key with its class, the rows of equal words, and its set's links.

    The class is named by its least key. Copies aren't expanded into pairs. Cases are defined as for similar_pairs(); a
    key without partners is a class of its own, one without words has no row, one with several contents joins their
    classes (that is no link) and has the links of all of them.
    """
    members, sets = word_classes(records, key, texts)
    edges = similar_sets(sets, threshold, bands, rows).select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).checkpoint()
    least = members.groupBy("key").agg(F.min("set_id").alias("a"), F.count("*").alias("c")).filter("c > 1").select("key", "a")
    own = members.join(least, "key").select("a", F.col("set_id").alias("b")).filter("a <> b")  # the sets of a key go together
    classes = components(edges.unionByName(own)).withColumnRenamed("id", "set_id")
    links = edges.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("links"))
    about = members.groupBy("set_id").agg(F.count("*").alias("copies"), F.min("key").alias("least")).join(classes, "set_id", "left").join(links, "set_id", "left")
    about = about.select("set_id", F.coalesce("class_id", "set_id").alias("own"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "least")
    named = about.groupBy("own").agg(F.min("least").alias("class_id"))
    about = about.join(named, "own").select("set_id", "class_id", "copies", "links")
    return members.join(about, "set_id").groupBy("key").agg(F.min("class_id").alias("class_id"), F.max("copies").alias("copies"), F.sum("links").alias("links"))


def every_class(records: DataFrame, key: str, texts: list[str], threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As duplicate_classes(), with a row for the keys without words as well: a class of their own, 1 copy, 0 links."""
    keys = records.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    found = keys.join(duplicate_classes(records, key, texts, threshold, bands, rows), "key", "left")
    return found.select("key", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
