"""A whole corpus as token ids of a public byte-level BPE vocabulary, in SQL higher-order functions.

The text is cut into words by the vocabulary's published pattern. A fold over the byte array of a word applies the
ranked merges: each step joins the neighbouring pieces of lowest rank, leftmost first, and looks up the new ranks. The
ranks are a literal of the plan: an array of small maps, addressed by hash, since a map of 50,000 entries is searched
from one end to the other. The fold runs once for each word of a dictionary of the corpus's most frequent words (bounded
by a parameter, counted over all texts) and, in place, for the words outside it; so tokens are never shuffled.
"""

from __future__ import annotations

import base64
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the vocabulary's pattern means it. Fixed value.
WS = r"\t-\r\x85\xa0 \x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The published word pattern of the vocabulary. Fixed value.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
BUCKETS = 8192
#: Most words that the dictionary holds.
DICTIONARY_WORDS = 50_000
#: Steps that the fold of a word takes before it looks whether the word is done.
RUN = 64
#: Rank of a pair that doesn't merge.
NONE = 2_147_483_647


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a base64 piece and its rank in each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def _bucket(hexes: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(hexes), F.lit(buckets)).cast("int")


def rank_literal(spark: SparkSession, ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """The ranks as a constant array<map<hex, rank>>: element xxhash64(hex) mod buckets holds the pieces of that hash."""
    pieces = spark.createDataFrame([(p.hex().upper(), r) for p, r in ranks.items()], "hex string, rank int")
    filled: dict[int, dict[str, int]] = defaultdict(dict)
    for b, h, r in pieces.select(_bucket(F.col("hex"), buckets), "hex", "rank").toLocalIterator():  # one row per vocabulary entry
        filled[b][h] = r
    return F.from_json(F.lit(json.dumps([filled.get(i, {}) for i in range(buckets)], separators=(",", ":"))), "array<map<string,int>>")


def _rank(table: Column, hexes: Column, buckets: int) -> Column:
    return F.coalesce(F.try_element_at(F.get(table, _bucket(hexes, buckets)), hexes), F.lit(NONE))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas don't share common subexpressions otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, table: Column, buckets: int = BUCKETS) -> Column:
    """The ids of one word (string) of any length by a fold of ranked merges over its bytes. table: rank_literal() or a variable of it.

    A step joins all pairs of the lowest rank at once, from the left and without overlap, so that there are about as many
    steps as different ranks. That is the same as joining them one by one unless a joined piece makes a pair of still
    lower rank with a neighbour, which would come first; then the step goes no further than that piece.
    """
    none, marks = F.array().cast("array<int>"), F.array().cast("array<string>")

    def rank(hexes: Column) -> Column:
        return _rank(table, hexes, buckets)

    def state_of(parts: Column, ranks: Column, low: Column, sel: Column) -> Column:
        return F.struct(parts.alias("parts"), ranks.alias("ranks"), low.alias("low"), sel.alias("sel"))

    def start(parts: Column) -> Column:
        pairs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: rank(F.concat(p, F.get(parts, i + 1))))
        return state_of(parts, pairs, F.lit(NONE), marks)

    # A step takes three turns of the fold, as Spark's time to analyse nested lambdas grows with a power of their depth.
    def merge(state: Column, turn: Column) -> Column:
        parts, ranks, sel = state.parts, state.ranks, state.sel
        pair = lambda i: F.concat(F.get(parts, i), F.get(parts, i + 1))
        joined = lambda i: F.coalesce(F.get(sel, i) == "1", F.lit(False))

        def choose(low: Column) -> Column:
            """Turn 0: '1' for each pair of the lowest rank that is joined, '0' for the others."""
            every = F.array_join(F.transform(ranks, lambda r: F.when(r == low, "1").otherwise("0")), "")
            found = state_of(parts, ranks, low, F.regexp_extract_all(F.replace(every, F.lit("11"), F.lit("10")), F.lit("."), F.lit(0)))
            return F.when(low < NONE, found).otherwise(state_of(parts, none, low, marks))

        def lower(mark: Column, i: Column) -> Column:
            """Whether the piece joined at i makes a pair of lower rank with what then stands beside it."""
            before = F.when(F.get(sel, i - 2) == "1", pair(i - 2)).otherwise(F.get(parts, i - 1))
            right = (i + 2 < F.size(parts)) & (rank(F.concat(pair(i), F.get(parts, i + 2))) < state.low)
            left = (i > 0) & (rank(F.concat(before, pair(i))) < state.low)
            return F.when(mark == "1", F.coalesce(right | left, F.lit(False))).otherwise(False)

        def until(at: Column) -> Column:
            """Turn 1: nothing after the first such piece."""
            return state_of(parts, ranks, state.low, F.when(at == 0, sel).otherwise(F.transform(sel, lambda mark, i: F.when(i < at, mark).otherwise("0"))))

        def join(at: Column) -> Column:
            """Turn 2: the pieces that start at the places `at`, and the ranks of their pairs."""
            def renewed(new: Column) -> Column:
                changed = lambda i, j: joined(i) | joined(F.get(at, j + 1))
                pairs = F.transform(F.slice(at, 1, F.size(at) - 1), lambda i, j: F.when(changed(i, j), rank(F.concat(F.get(new, j), F.get(new, j + 1)))).otherwise(F.get(ranks, i)))
                return state_of(new, pairs, state.low, marks)

            return _let(F.transform(at, lambda i: F.when(joined(i), pair(i)).otherwise(F.get(parts, i))), renewed)

        kept = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (i == 0) | ~joined(i - 1))
        return (
            F.when(F.size(ranks) == 0, state).when(turn % 3 == 0, _let(F.coalesce(F.array_min(ranks), F.lit(NONE)), choose))
            .when(turn % 3 == 1, _let(F.array_position(F.transform(sel, lower), F.lit(True)), until)).otherwise(_let(kept, join))
        )

    def folded(octets: Column) -> Column:
        # steps come in runs of RUN: a run of a word that is done is skipped, as each turn copies the pieces
        steps = F.size(octets) - 1
        turns = F.sequence(F.lit(0), 3 * F.least(steps, F.lit(RUN)) - 1)
        run = lambda state, _: F.aggregate(F.when(F.size(state.ranks) > 0, turns).otherwise(none), state, merge)
        return F.aggregate(F.sequence(F.lit(0), F.floor(steps / RUN).cast("int")), start(octets), run, lambda s: F.transform(s.parts, rank))

    def encoded(hexes: Column) -> Column:
        return _let(rank(hexes), lambda r: F.when((r < NONE) | (F.length(hexes) < 4), F.array(r)).otherwise(_let(F.regexp_extract_all(hexes, F.lit(".."), F.lit(0)), folded)))

    return _let(F.hex(F.encode(word, "UTF-8")), encoded)


def cut_words(text: Column) -> Column:
    """The words of a text by the vocabulary's pattern, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _dictionary(texts: DataFrame, table: Column, size: int, buckets: int) -> Column:
    """array<map<word, ids>> of the `size` most frequent words: counted over all texts, made in parallel."""
    spark = texts.sparkSession
    counts = texts.select(F.explode(cut_words(F.col("text"))).alias("w")).groupBy("w").count()
    frequent = counts.orderBy(F.desc("count"), "w").limit(size)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = frequent.repartition(spread, F.xxhash64("w")).select("w", _let(table, lambda t: fold_merges(F.col("w"), t, buckets)).alias("ids"))
    filled: dict[int, dict[str, list[int]]] = defaultdict(dict)
    for b, w, i in ids.select(_bucket(F.col("w"), buckets), "w", "ids").toLocalIterator():  # at most `size` rows
        filled[b][w] = i
    return F.from_json(F.lit(json.dumps([filled.get(i, {}) for i in range(buckets)], separators=(",", ":"))), "array<map<string,array<int>>>")


def encode_corpus(documents: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text", dictionary_words: int = DICTIONARY_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(key, ids): the token ids of every row of documents, without special tokens, one row for one row.

    Their strings in a text are ordinary text. A null and an empty text have no ids (an empty list). Blank texts, odd
    scripts and signs are bytes like others. Nothing is dropped or cut: words outside the dictionary, of any length, are
    folded where they stand. Repeated rows come out repeated; an empty table gives no row; other columns of documents don't matter.
    """
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    table = rank_literal(documents.sparkSession, ranks, buckets)
    known = _dictionary(rows, table, dictionary_words, buckets)

    def ids_of(words: Column, t: Column, k: Column) -> Column:
        found = lambda w: F.try_element_at(F.get(k, _bucket(w, buckets)), w)
        return F.flatten(F.transform(words, lambda w: F.coalesce(found(w), fold_merges(w, t, buckets))))

    return rows.select("key", _let(table, lambda t: _let(known, lambda k: ids_of(cut_words(F.col("text")), t, k))).alias("ids"))


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The text of a list of ids: its binary pieces put together. Ids outside the vocabulary make the result null."""
    size = max(ranks.values()) + 1
    hexes = [""] * size
    for piece, rank in ranks.items():
        hexes[rank] = piece.hex().upper()
    table = F.from_json(F.lit(json.dumps(hexes, separators=(",", ":"))), "array<string>")
    pieces = _let(table, lambda t: F.transform(ids, lambda i: F.get(t, i)))
    return _let(pieces, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.decode(F.unhex(F.array_join(p, "")), "UTF-8")))
