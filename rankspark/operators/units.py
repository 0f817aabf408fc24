"""Quantities in different units, brought to common ones: durations to minutes, amounts to grams or millilitres.

The SQL extracts number and unit with regular expressions, normalises the unit's spelling by a join with an alias table,
takes the unit of the text before that of the field's source, then applies the unit's factor and offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions.text import FRACTIONS
from rankspark.operators.packed import SPACES

#: Spellings of unit codes, lower case, without the final full stop. Fixed values.
ALIASES = {
    "s": "s sec secs second seconds sek sekunde sekunden seconde secondes segundo segundos",
    "min": "min mins minute minutes minuten minuto minutos mn m ' ′",
    "h": "h hr hrs hour hours std stunde stunden heure heures hora horas",
    "d": "d day days tag tage tagen jour jours día días dia dias",
    "tsp": "tsp tsps teaspoon teaspoons",
    "tbsp": "tbsp tbsps tbs tablespoon tablespoons",
    "cup": "cup cups",
    "fl_oz": "fl oz|fl. oz|fl ozs|fluid ounce|fluid ounces|fluid oz|floz",
    "pint": "pint pints pt pts",
    "quart": "quart quarts qt qts",
    "ml": "ml mls millilitre millilitres milliliter milliliters cc",
    "cl": "cl centilitre centilitres centiliter centiliters",
    "dl": "dl decilitre decilitres deciliter deciliters",
    "l": "l litre litres liter liters",
    "g": "g gr gm gms gram grams gramme grammes",
    "kg": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes",
    "oz": "oz ozs ounce ounces",
    "lb": "lb lbs pound pounds",
}
#: Numbers in words. Fixed values.
WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")

_SIGN = "[" + "".join(FRACTIONS) + "]"
_WORD = "(?:" + "|".join(WORDS) + r")(?!\p{L})"
NUMBER = rf"(?:(?:\d+|{_WORD}) \d+/\d+|\d+ ?{_SIGN}|{_SIGN}|\d+/\d+|\d+(?:[.,]\d+)?|[.,]\d+|(?<!\p{{L}}){_WORD})"
DURATION_CODES = ("s", "min", "h", "d")


def alias_rows() -> list[tuple[str, str]]:
    """(alias, unit_code) of every spelling; about a hundred rows, fixed."""
    return [(a, code) for code, names in ALIASES.items() for a in (names.split("|") if "|" in names else names.split())]


def alias_table(spark: SparkSession) -> DataFrame:
    """The alias table as rows (alias, unit_code)."""
    values = ", ".join("('{}', '{}')".format(a.replace("'", "\\'"), c) for a, c in alias_rows())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(alias, unit_code)")


def _units_pattern(durations: bool) -> str:
    names = [a for a, c in alias_rows() if (c in DURATION_CODES) == durations]
    return "(?:" + "|".join(sorted((n.replace(".", r"\.").replace(" ", " ?") for n in names), key=lambda n: (-len(n), n))) + ")"


def unit_scale(spark: SparkSession, unit_reference: DataFrame) -> DataFrame:
    """(alias, unit_code, base_unit, factor, offset): base = value * factor + offset; a reference without offset has 0."""
    offset = F.coalesce(F.col("offset"), F.lit(0.0)) if "offset" in unit_reference.columns else F.lit(0.0)
    known = unit_reference.select("unit_code", "base_unit", F.col("factor").cast("double").alias("factor"), offset.alias("offset"))
    return alias_table(spark).join(known, "unit_code")


def plain_numbers(text: Column) -> Column:
    """Lower case, one kind of space, halves and quarters in words as fractions, 'a' and 'an' before a unit as 1."""
    text = F.lower(F.regexp_replace(F.regexp_replace(text, "⁄", "/"), rf"[{SPACES}]+", " "))
    text = F.regexp_replace(text, rf"({_WORD}) and a half\b", "$1 1/2")
    text = F.regexp_replace(text, r"\b(?:a |an |one |1 )?half (?:of )?(?:an? )?", "1/2 ")
    text = F.regexp_replace(text, r"\bthree quarters? (?:of )?(?:an? )?", "3/4 ")
    text = F.regexp_replace(text, r"\b(?:a |one |1 )?quarter (?:of )?(?:an? )?", "1/4 ")
    return F.trim(F.regexp_replace(text, rf"\ban? (?=(?:{_units_pattern(False)}|{_units_pattern(True)})(?!\p{{L}}))", "1 "))


def number_value(number: Column) -> Column:
    """The value of '1 3/4', '1 ¾', '3/4', '1.5', '0,75' or 'two' as double; null for anything else and over zero."""
    named = F.create_map(*[F.lit(x) for k, v in ({w: i + 1.0 for i, w in enumerate(WORDS)} | {k: a / b for k, (a, b) in FRACTIONS.items()}).items() for x in (k, v)])

    def value(part: Column) -> Column:
        ratio = F.try_divide(F.substring_index(part, "/", 1).try_cast("double"), F.substring_index(part, "/", -1).try_cast("double"))
        return F.when(F.contains(part, F.lit("/")), ratio).otherwise(F.coalesce(F.try_element_at(named, part), F.replace(part, F.lit(","), F.lit(".")).try_cast("double")))

    # the parts are added; lambdas see each part once, where repeated columns would be computed again in every branch
    parts = F.split(F.regexp_replace(number, rf"(?<=\d)(?={_SIGN})", " "), " ")
    return F.aggregate(F.transform(parts, value), F.lit(0.0), lambda total, v: total + v)


def durations(spark: SparkSession, rows: DataFrame, sources: DataFrame, unit_reference: DataFrame) -> DataFrame:
    """Minutes of each row of rows(recipe_id, value, text, source): (recipe_id, minutes), only where above 0.

    The text's time if it gives one with its unit (several parts are added; clock form '2:30 h', ISO 'PT1H20M' and
    '1h20' count), else value in the source's unit. Null, blank or unreadable texts, unknown units, NaN and infinite
    values, and sources that aren't listed or name no unit give nothing of their own.
    """
    unit = _units_pattern(True)
    text = plain_numbers(F.col("text"))
    text = F.regexp_replace(text, r"\bpt?(?=[\d.]+[dhms])((?:[\d.]+d)?t?(?:[\d.]+h)?(?:[\d.]+m)?(?:[\d.]+s)?)", "$1")
    text = F.regexp_replace(text, r"(\d+):(\d\d) ?(?:h|hrs?|hours?|std)\b\.?", "$1 h $2 min")
    text = F.regexp_replace(text, r"(\d ?(?:h|hrs?|hours?|std)\.?) ?(\d{1,2})(?![\d.,/:]| ?[\p{L}'′])", "$1 $2 min")
    text = F.regexp_replace(text, rf"({NUMBER}) ?(?:-|–|to|bis) ?{NUMBER}(?= ?{unit}(?![\p{{L}}]))", "$1")
    found = F.regexp_extract_all(text, F.lit(rf"((?<![\d/.,]){NUMBER}) ?-?{unit}(?!\p{{L}})"), F.lit(0))
    scale = unit_scale(spark, unit_reference).filter(F.col("base_unit") == "min")
    parts = (
        rows.select("recipe_id", F.explode_outer(found).alias("part"))
        .filter("part IS NOT NULL")
        .select("recipe_id", number_value(F.regexp_extract("part", f"^({NUMBER})", 1)).alias("n"), F.regexp_extract("part", f"({unit})$", 1).alias("alias"))
        .join(scale, "alias")
        .groupBy("recipe_id")
        .agg(F.sum(F.col("n") * F.col("factor") + F.col("offset")).alias("said"))
    )
    plain = unit_scale(spark, unit_reference).filter(F.col("base_unit") == "min").select("unit_code", "factor", "offset").distinct()
    default = sources.select("source", F.col("duration_unit").alias("unit_code")).join(plain, "unit_code").select("source", "factor", "offset")
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    minutes = F.coalesce("said", value * F.col("factor") + F.col("offset"))
    return rows.join(parts, "recipe_id", "left").join(default, "source", "left").select("recipe_id", minutes.alias("minutes")).filter("minutes > 0")


def amounts(spark: SparkSession, items: DataFrame, unit_reference: DataFrame) -> DataFrame:
    """The first amount with a unit of mass or volume in each item: items' columns, unit_code ('g', 'ml'), amount double.

    Of a range the lower end; two units together ('2 lb 3 oz', the second smaller and of the same kind) are added; what
    follows in brackets or after a slash is a second way to say it and not looked at. Items without such an amount, null
    and empty items give no row.
    """
    unit = _units_pattern(False)
    number = rf"(?<![\d/.,]){NUMBER}"
    ranged = rf"({number})(?: ?(?:-|–|—|to|or) ?{NUMBER})?"
    whole = rf"{ranged} ?-?({unit})(?!\p{{L}})\.?(?: ?(?:and|plus|\+|&)? ?({NUMBER}) ?({unit})(?!\p{{L}}))?"
    # the long text is searched once: an outer explode keeps filters from being pushed below and computing it again
    found = F.filter(F.array(F.regexp_extract(plain_numbers(F.col("item")), whole, 0)), lambda m: m != "")
    tidy = lambda c: F.regexp_replace(c, r"\. ?", " ")
    read = items.select(*items.columns, F.explode_outer(found).alias("__m")).filter("__m IS NOT NULL").select(
        *items.columns,
        number_value(F.regexp_extract("__m", whole, 1)).alias("__n1"), F.regexp_replace(tidy(F.regexp_extract("__m", whole, 2)), "^floz$", "fl oz").alias("__u1"),
        number_value(F.regexp_extract("__m", whole, 3)).alias("__n2"), tidy(F.regexp_extract("__m", whole, 4)).alias("__u2"),
    )
    scale = unit_scale(spark, unit_reference).filter(F.col("base_unit").isin("g", "ml"))
    first = scale.select(F.col("alias").alias("__u1"), F.col("base_unit").alias("unit_code"), F.col("factor").alias("__f1"), F.col("offset").alias("__o1"))
    second = scale.select(F.col("alias").alias("__u2"), F.col("base_unit").alias("__b2"), F.col("factor").alias("__f2"))
    more = F.when((F.col("__b2") == F.col("unit_code")) & (F.col("__n2") * F.col("__f2") < F.col("__f1")), F.col("__n2") * F.col("__f2"))
    return (
        read.join(first, "__u1").join(second, "__u2", "left")
        .select(*items.columns, "unit_code", (F.col("__n1") * F.col("__f1") + F.col("__o1") + F.coalesce(more, F.lit(0.0))).alias("amount"))
        .filter(F.col("amount").isNotNull())
    )


def recipe_quantities(spark: SparkSession, recipe: DataFrame, feed_source: DataFrame, unit_reference: DataFrame, items: DataFrame) -> DataFrame:
    """Both fields of recipe in base units, rounded: recipe_id, field_name, position, unit_code, amount.

    items: the values of recipe.ingredients as (recipe_id, position, item). Copies of a recipe row count once; half a
    unit is rounded up.
    """
    rows = recipe.select(F.col("id").cast("bigint").alias("recipe_id"), F.col("prep_minutes").cast("double").alias("value"), F.col("prep_text").alias("text"), "source").distinct()
    times = durations(spark, rows, feed_source, unit_reference)
    times = times.select("recipe_id", F.lit("prep_minutes").alias("field_name"), F.lit(0).alias("position"), F.lit("min").alias("unit_code"), F.col("minutes").alias("amount"))
    parts = amounts(spark, items, unit_reference).select("recipe_id", F.lit("ingredients").alias("field_name"), "position", "unit_code", "amount")
    return times.unionByName(parts).withColumn("amount", F.round("amount").cast("bigint"))
