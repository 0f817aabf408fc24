import pytest

from rankspark.operators import units

REFERENCE = [("s", "min", 1 / 60), ("min", "min", 1.0), ("h", "min", 60.0), ("d", "min", 1440.0), ("tsp", "ml", 4.92892), ("tbsp", "ml", 14.78676), ("cup", "ml", 236.588), ("fl_oz", "ml", 29.57353), ("pint", "ml", 473.176), ("ml", "ml", 1.0), ("cl", "ml", 10.0), ("dl", "ml", 100.0), ("l", "ml", 1000.0), ("g", "g", 1.0), ("kg", "g", 1000.0), ("oz", "g", 28.34952), ("lb", "g", 453.59237)]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(REFERENCE, "unit_code string, base_unit string, factor double")


AMOUNTS = {
    "1 ¾ cups figs": ("ml", 414), "2 ⅓ Cups (about 550 ml) cocoa": ("ml", 552), "½ kilograms rice": ("g", 500), "0,75L oil": ("ml", 750), ".5 dl cream": ("ml", 50), "3–4 oz. ham": ("g", 85), "2 to 3 Tbsp mint": ("ml", 30),
    "1 lb 4 oz beef": ("g", 567), "2 lbs 11 ounces x": ("g", 1219), "3 tablespoons / 45 ml x": ("ml", 44), "1 tin (200 ml) x": ("ml", 200), "shallots, 2 cl": ("ml", 20), "1½ fl. oz. x": ("ml", 44), "two cups x": ("ml", 473),
    "half a cup of x": ("ml", 118), "a cup of tea": ("ml", 237), "100 g - 150 g x": ("g", 100), "12 large eggs": None, "a 2-inch piece": None, "2% milk": None, "7-grain bread": None, "1/0 cups x": None, "": None, None: None, "Topping:": None, "g": None,
}
TIMES = {
    "40 minutes": 40, "2h10": 130, "6½ hrs": 390, "3/4 hour": 45, "PT1H20M": 80, "PT10M": 10, "pt24h": 1440, "2:00 h": 120, "55'": 55, "Prep: 5 min.": 5, "1 day 1 hrs": 1500, "half an hour": 30, "three quarters of an hour": 45,
    "a quarter of an hour": 15, "1 Std. 45 Min.": 105, "4,5 h": 270, "1200 seconds": 20, "2 1/2 hours": 150, "an hour": 60, "one and a half hours": 90, "2-3 hours": 120, "1 h 20": 80,
}


def test_amounts(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(AMOUNTS)]
    got = {r.recipe_id: (r.unit_code, int(r.amount + 0.5)) for r in units.amounts(spark, spark.createDataFrame(rows, "recipe_id long, item string, alias string"), reference).collect()}
    assert got == {i: v for i, v in enumerate(AMOUNTS.values()) if v}


def test_durations(spark, reference):
    sources = spark.createDataFrame([("a", "s"), ("b", None), ("c", "furlong")], "source string, duration_unit string")
    rows = [(i, 7200.0, t, "a") for i, t in enumerate(TIMES)]
    rows += [(100, 600.0, "a while", "a"), (101, 600.0, None, "b"), (102, 5.0, "", "c"), (103, -1.0, None, "a"), (104, float("nan"), None, "a"), (105, None, "see notes", "a"), (106, 9.0, None, None), (107, 9.0, "0 min", "a"), (108, 120.0, "7200", "a"), (109, 60.0, "x" * 100_000, "a")]
    got = {r.recipe_id: round(r.minutes, 2) for r in units.durations(spark, spark.createDataFrame(rows, "recipe_id long, value double, text string, source string"), sources, reference).collect()}
    assert got == {i: v for i, v in enumerate(TIMES.values())} | {100: 10, 108: 2, 109: 1}


def test_both_fields_repeats_offsets_and_empty(spark, reference):
    recipe = spark.createDataFrame([(1, 90.0, None, "a", "z"), (1, 90.0, None, "a", "y"), (2, 1.0, "1 h", "a", "z")], "id int, prep_minutes double, prep_text string, source string, factor string")
    source = spark.createDataFrame([("a", "s", 1)], "source string, duration_unit string, value int")
    items = spark.createDataFrame([(1, 1, "2 eggs"), (1, 2, "1 kg rice")], "recipe_id long, position int, item string")
    out = {tuple(r) for r in units.recipe_quantities(spark, recipe, source, reference, items).collect()}
    assert out == {(1, "prep_minutes", 0, "min", 2), (2, "prep_minutes", 0, "min", 60), (1, "ingredients", 2, "g", 1000)}
    assert units.recipe_quantities(spark, recipe.limit(0), source, reference, items.limit(0)).count() == 0
    from pyspark.sql import functions as F

    shifted = reference.withColumn("offset", F.when(F.col("unit_code") == "kg", 5.0).otherwise(0.0))
    assert [r.amount for r in units.amounts(spark, items, shifted).collect()] == [1005.0]
