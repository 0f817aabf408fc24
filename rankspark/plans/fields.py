"""Queries over packed and measured fields (p2, p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators.packed import infer_delimiters, list_items, packed_rows
from rankspark.operators.units import recipe_quantities
from rankspark.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per value of raw_recipes.ingredients and recipe.ingredients."""
    return list_items(table(spark, folder, "raw_recipes"), table(spark, folder, "recipe"))


def p3_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    """What the inference says of each source of both recipe tables and candidate delimiter."""
    return infer_delimiters(packed_rows(table(spark, folder, "raw_recipes"), table(spark, folder, "recipe")), "s", "ingredients")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Preparation times in minutes and ingredient amounts in grams or millilitres."""
    recipe = table(spark, folder, "recipe")
    every = list_items(table(spark, folder, "raw_recipes"), recipe)  # p3_found's inference over both tables, so that positions agree
    items = every.filter("table_name = 'recipe'").select(F.col("recipe_key").alias("recipe_id"), "position", "item")
    return recipe_quantities(spark, recipe, table(spark, folder, "feed_source"), table(spark, folder, "unit_reference"), items)


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_delimiters": p3_delimiters}
ORACLES: dict[str, str] = {}
