"""Items over a size limit cut at natural boundaries, with overlap.

A text becomes an array of units (words with the white space after them, or characters) and a shape string with one
letter per unit that says how strong a boundary follows it. A regular expression with bounded quantifiers is run over
the shape: its alternatives, strongest boundary first, consume up to the limit, and the last takes any units at all.
The lengths of the matches are the offsets of the pieces; an offset looked back by the overlap is where a piece starts.
All of it is SQL array functions. As each alternative is one character class with a bounded quantifier, the pattern
doesn't backtrack across units or nest, so limits of thousands of units are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: Shape letters from the strongest boundary to the weakest, and the unit that ends in each: fixed values.
BOUNDARIES = (
    ("P", rf"\n[^\S\n]*\n{SPACE}*$|\x{{2029}}{SPACE}*$"),
    ("L", rf"[\n\r\x85\x{{2028}}]{SPACE}*$"),
    ("S", rf"[.!?…。！？][\"'”’»)\]]*{SPACE}+$"),
    ("C", rf"[,;:|·•–—][\"'”’»)\]]*{SPACE}+$"),
    ("W", rf"{SPACE}$"),
)


def words(text: Column) -> Column:
    """The white-space separated words of text, each with the white space after it (the first also with that before)."""
    return F.regexp_extract_all(text, F.lit(rf"(?:^{SPACE}+)?{NOT_SPACE}+{SPACE}*"), F.lit(0))


def _shape(units: Column) -> Column:
    """One letter per unit; 'x' where no boundary follows."""
    def letter_of(u: Column) -> Column:
        chosen = F.lit("x")
        for letter, pattern in reversed(BOUNDARIES):
            chosen = F.when(u.rlike(pattern), letter).otherwise(chosen)
        return chosen

    return F.array_join(F.transform(units, letter_of), "")


def _pattern(limit: Column, least: Column) -> Column:
    """Up to limit shape letters: at least `least` of them up to the last strong boundary, else as many as there are."""
    low, high = (least - 1).cast("string"), (limit - 1).cast("string")
    strong = [F.concat(F.lit("[A-Za-z]{"), low, F.lit(","), high, F.lit("}" + letter + "|")) for letter, _ in BOUNDARIES]
    # what is left is taken whole if it fits
    return F.concat(F.lit("[A-Za-z]{1,"), limit.cast("string"), F.lit("}$|"), *strong, F.lit("[A-Za-z]{1,"), limit.cast("string"), F.lit("}"))


def split_oversized(rows: DataFrame, key: str, text: str, size: str, overlap: str, unit: str = "word") -> DataFrame:
    """(key, piece_no from 1, pieces, first_unit from 0, units, piece): every text of rows as pieces of at most `size` units.

    unit: 'word' (white-space separated) or 'char'. A text within its limit is one piece, as it is; a longer one is cut
    at a paragraph, line, sentence, clause or word end, whichever is the strongest in the second half of what fits,
    and each piece after the first starts with the last `overlap` units of the one before. A null size is no limit, a
    null or negative overlap none; an overlap of `size` or more is taken as size - 1; a size under 1 as 1. Null, empty
    and blank texts give no row. Equal rows are taken once. Pieces of cut texts are trimmed, their inner white space kept.
    """
    base = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.when(F.col(size).isNotNull(), F.greatest(F.col(size).cast("int"), F.lit(1))).alias("size"), F.greatest(F.coalesce(F.col(overlap).cast("int"), F.lit(0)), F.lit(0)).alias("overlap"))
    base = base.filter(F.col("text").rlike(NOT_SPACE)).distinct()
    number = F.regexp_count("text", F.lit(f"{NOT_SPACE}+")) if unit == "word" else F.length("text")
    # so many words need more than twice as many characters: few texts need their words counted, and few of those are cut
    big = F.col("size").isNotNull() & (F.length("text") > (F.col("size") * 2 if unit == "word" else F.col("size"))) & (number > F.col("size"))
    whole = base.filter(~big).select("key", F.lit(1).alias("piece_no"), F.lit(1).alias("pieces"), F.lit(0).alias("first_unit"), number.alias("units"), F.col("text").alias("piece"))
    return whole.unionByName(_cut(base.filter(big), unit))


def _cut(rows: DataFrame, unit: str) -> DataFrame:
    """The pieces of rows(key, text, size, overlap), all of them over their size."""
    units = words(F.col("text")) if unit == "word" else F.regexp_extract_all(F.col("text"), F.lit("(?s)."), F.lit(0))
    size, over = F.col("size"), F.col("over")
    step = size - over
    # the first piece holds size units, at least as many as are looked back to; each later one adds up to size - overlap
    least_first = F.least(size, F.greatest(F.floor(size / 2).cast("int"), over, F.lit(1)))
    least = F.greatest(F.floor(step / 2).cast("int"), F.lit(1))
    cut = rows.withColumn("over", F.least(F.col("overlap"), size - 1)).withColumn("u", units).withColumn("shape", _shape(F.col("u")))
    cut = cut.withColumn("head", F.length(_first(F.col("shape"), _pattern(size, least_first))))
    tail = F.transform(F.regexp_extract_all(F.expr("substring(shape, head + 1)"), _pattern(step, least), F.lit(0)), lambda m: F.length(m))
    cut = cut.withColumn("lengths", F.concat(F.array("head"), tail))
    cut = cut.withColumn("ends", F.aggregate("lengths", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))))
    at = F.transform("lengths", lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get("ends", i) - over).alias("first_unit"), (F.get("ends", i + 1)).alias("end")))
    out = cut.select("key", "u", F.size("lengths").alias("pieces"), F.posexplode(at).alias("p", "at"))
    taken = F.col("at.end") - F.col("at.first_unit")
    piece = F.array_join(F.slice("u", F.col("at.first_unit") + 1, taken), "")
    trimmed = F.regexp_replace(piece, f"^{SPACE}+|{SPACE}+$", "") if unit == "word" else piece
    return out.select("key", (F.col("p") + 1).alias("piece_no"), "pieces", F.col("at.first_unit").alias("first_unit"), taken.alias("units"), trimmed.alias("piece"))


def _first(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, pattern, F.lit(0))[0]


def oversized(rows: DataFrame, key: str, text: str, size: str, overlap: str, unit: str = "word") -> DataFrame:
    """The keys whose text comes out of split_oversized() in more than one piece."""
    return split_oversized(rows, key, text, size, overlap, unit).filter("pieces > 1 AND piece_no = 1").select("key").distinct()
