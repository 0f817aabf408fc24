"""Lists packed into one string: infer the delimiters, then one value per row.

Strings of one source may be packed differently from each other, so a source has a set of delimiters rather than one.
A candidate belongs to the set when the pieces it makes look like single values (piece type regularity) and their number
is steady (piece-count consistency), compared with the source's best candidate; both are smoothed by what all sources
say of the candidate, so that a source with one string gets a sound answer. The comma is the delimiter of last resort, decided string by string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankspark.session import use_checkpoints

#: Signs that may separate values, besides the comma: those of lists, and those that also stand inside values. Fixed values.
LIST_SIGNS = ("\n", "\r", "\t", ";", "|", "·", "•")
CANDIDATES = (*LIST_SIGNS, "/", "-", "–", ":", ".", "(", "&", "+")
#: White space inside values, no-break and other Unicode spaces included. Fixed value.
SPACES = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A piece that looks like an entry of a list: a number, a counting or hedging word first, or a sub-heading. Fixed value.
ENTRY = (
    r"(?i)^[\"']?\s*(?:[\d.,]*\d|[¼½¾⅐-⅞]|(?:an?|one|two|three|four|five|six|half|about|approx\.?|ca\.?|generous|scant|zest|juice)\b)"
    r"|:\s*\"?$|\d\s*\p{L}{0,11}\.?\s*\"?$"
)
#: What is longer than so many characters is more than one value.
LONGEST_VALUE = 60
#: The share of the best candidate's score that an accepted one has.
MIN_SHARE = 0.6
#: Weight, in pieces, of what is held of a candidate before a source is read; and the regularity held of signs of lists and of others before any is.
PRIOR_PIECES = 40.0
PRIOR_LIST, PRIOR_OTHER = 0.9, 0.1


def _pattern(chars: Column) -> Column:
    """One delimiter and the value after it; inside quotes nothing separates, and a quote opens only where a value starts."""
    return F.concat(
        F.lit("(?s)["), chars, F.lit(rf"][{SPACES}&&[^"), chars, F.lit(r']]*("[^"\\]*+(?:(?:""|\\.)[^"\\]*+)*+"[^'),
        chars, F.lit("]*|[^"), chars, F.lit("]*)"),
    )


def _pieces(text: Column, chars: Column) -> Column:
    """The raw pieces of text, a delimiter put before it so that each match has one."""
    return F.regexp_extract_all(F.concat(F.substring(chars, 1, 1), text), _pattern(chars), F.lit(1))


def squeeze(text: Column) -> Column:
    """White space of any kind collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def clean_value(piece: Column) -> Column:
    """A value without its outer quotes and their escapes, white space squeezed."""
    bare = F.regexp_replace(piece, f"^[{SPACES}]+|[{SPACES}]+$", "")
    quoted = bare.rlike('(?s)^".*"$') & (F.length(bare) > 1)
    unescaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, '(?s)^"(.*)"$', "$1"), '""', '"'), r'\\(["\\])', "$1")
    return squeeze(F.when(quoted, unescaped).otherwise(bare))


def _is_json(text: Column) -> Column:
    return text.rlike(r'(?s)^\s*\[\s*".*\]\s*$')


def infer_delimiters(rows: DataFrame, source: str, packed: str) -> DataFrame:
    """One row per source and candidate delimiter found in it: source, delimiter, strings, regularity, consistency, accepted.

    regularity: share of the pieces that look like one value: an entry with letters in it, without another sign of
    lists inside, and of a value's length; consistency: 1 / (1 + variation coefficient of the piece counts). Both are taken over all strings of the source
    that the candidate splits by itself, smoothed by the candidate's figures over all sources. A candidate is accepted if
    its regularity times the root of its consistency is at least MIN_SHARE of that of the source's best candidate and of the
    one that is best over all sources: so signs that stand inside values, which
    cut lists into pieces of several values or values into parts, are refused. Null and blank strings and JSON arrays
    say nothing; a null source is one source of its own.
    """
    text = F.col(packed)
    per_string = F.array(
        *[F.when(F.contains(text, F.lit(c)), F.struct(F.lit(c).alias("delimiter"), F.filter(_pieces(text, F.lit(c)), lambda p: p.rlike(rf"[^{SPACES}]")).alias("pieces"))) for c in CANDIDATES]
    )
    several = lambda p: p.rlike(rf"[^{SPACES}][{SPACES}]*[\n\r\t;|·•][{SPACES}]*[^{SPACES}]")
    one = lambda p: (F.length(F.trim(p)) <= LONGEST_VALUE) & p.rlike(ENTRY) & p.rlike(r"\p{L}{2}") & ~several(p)
    split = rows.filter(~_is_json(text)).select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.explode(F.filter(per_string, lambda x: x.isNotNull())).alias("c")).select(
        "source", F.col("c.delimiter").alias("delimiter"), F.size("c.pieces").cast("double").alias("n"), F.size(F.filter(F.col("c.pieces"), one)).cast("double").alias("entries"),
    )
    sums = split.groupBy("source", "delimiter").agg(
        F.count("*").alias("strings"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("entries").alias("entries")
    )
    use_checkpoints(rows.sparkSession)
    sums = sums.checkpoint()  # used three times, a row per source and candidate: the strings are cut once
    held = F.when(F.col("delimiter").isin(*LIST_SIGNS), PRIOR_LIST).otherwise(PRIOR_OTHER)
    overall = sums.groupBy("delimiter").agg(((F.sum("entries") + PRIOR_PIECES * F.first(held)) / (F.sum("n") + PRIOR_PIECES)).alias("all_regular"), F.sum("strings").alias("s"), F.sum("n").alias("sn"), F.sum("n2").alias("sn2"))
    mean = F.col("n") / F.col("strings")
    cv = F.sqrt(F.greatest(F.lit(0.0), F.col("n2") / F.col("strings") - mean * mean)) / mean
    all_mean = F.col("sn") / F.col("s")
    all_cv = F.sqrt(F.greatest(F.lit(0.0), F.col("sn2") / F.col("s") - all_mean * all_mean)) / all_mean
    weight = F.col("n") / (F.col("n") + PRIOR_PIECES)
    scored = (
        sums.filter(F.col("n") > 0)
        .join(overall, "delimiter")
        .select(
            "source", "delimiter", "strings",
            ((F.col("entries") + PRIOR_PIECES * F.col("all_regular")) / (F.col("n") + PRIOR_PIECES)).alias("regularity"),
            (1 / (1 + weight * cv + (1 - weight) * all_cv)).alias("consistency"),
        )
    )
    best_of_all = overall.agg(F.coalesce(F.max(F.col("all_regular") * F.sqrt(1 / (1 + all_cv))), F.lit(0.0)).alias("best_of_all"))
    score = F.col("regularity") * F.sqrt("consistency")
    best = F.greatest(F.max(score).over(Window.partitionBy("source")), "best_of_all")  # one row per candidate
    return scored.join(F.broadcast(best_of_all)).withColumn("accepted", score >= MIN_SHARE * best).drop("best_of_all")  # one row


def split_packed(rows: DataFrame, key: str, source: str, packed: str) -> DataFrame:
    """One row per value: (key, position from 1, item), in the order of the string; empty values are not counted.

    A JSON array of strings is read as such. Otherwise the delimiters accepted for the source separate outside quotes;
    the comma does so only in strings where none of them occurs outside quotes. Rows with a null or blank string give
    nothing; equal rows (key and string) are taken once; a null key stays a key; other columns of rows don't matter.
    """
    base = rows.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(packed).cast("string").alias("packed"))
    base = base.filter(F.col("packed").isNotNull() & F.col("packed").rlike(f"[^{SPACES}]")).distinct()
    # packed text is small in bytes and dear to split: partitions by number, which adaptive execution doesn't merge by size
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    base = base.repartition(tasks, F.xxhash64("key", "packed"))
    chars = (
        infer_delimiters(base, "source", "packed")
        .filter("accepted")
        .groupBy("source")
        .agg(F.array_join(F.array_sort(F.collect_set("delimiter")), "").alias("chars"))  # at most one of each candidate
    )
    joined = base.join(chars, "source", "left").withColumn("chars", F.coalesce("chars", F.lit("")))
    joined = joined.repartition(tasks, F.xxhash64("key", "packed"))  # the join's own partitions would be merged by size
    text, own = F.col("packed"), F.col("chars")
    everything = F.concat(F.lit(","), own)
    heads = F.regexp_extract_all(F.concat(F.lit(","), text), _pattern(everything), F.lit(0))
    other = (own != "") & F.exists(heads, lambda h: ~h.startswith(","))
    json = F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(text, "array<string>"))
    bracketed = F.when(_is_json(text), F.regexp_replace(text, r"(?s)^\s*\[|\]\s*$", "")).otherwise(text)
    values = F.coalesce(json, F.transform(F.when(other, _pieces(text, own)).otherwise(_pieces(bracketed, F.lit(","))), clean_value))
    kept = F.filter(F.transform(values, squeeze), lambda v: v != "")
    return joined.select("key", F.posexplode(kept).alias("p", "item")).select("key", (F.col("p") + 1).cast("int").alias("position"), "item")


def packed_rows(raw_recipes: DataFrame, recipe: DataFrame) -> DataFrame:
    """The packed ingredients of both recipe tables: k (table and key), s (source), ingredients. raw_recipes' revisions stand for sources."""
    raw = raw_recipes.select(F.struct(F.lit("raw_recipes").alias("t"), F.col("recipe_idx").cast("bigint").alias("k")).alias("k"), F.concat(F.lit("raw:"), F.coalesce("dataset_revision", F.lit(""))).alias("s"), "ingredients")
    own = recipe.select(F.struct(F.lit("recipe").alias("t"), F.col("id").cast("bigint").alias("k")).alias("k"), F.concat(F.lit("recipe:"), F.coalesce("source", F.lit(""))).alias("s"), "ingredients")
    return raw.unionByName(own).filter("ingredients IS NOT NULL").distinct()


def list_items(raw_recipes: DataFrame, recipe: DataFrame) -> DataFrame:
    """The ingredient values of both recipe tables: table_name, recipe_key, position, item. Copies of a row (later loads) count once."""
    items = split_packed(packed_rows(raw_recipes, recipe), "k", "s", "ingredients")
    return items.select(F.col("key.t").alias("table_name"), F.col("key.k").alias("recipe_key"), "position", "item")
