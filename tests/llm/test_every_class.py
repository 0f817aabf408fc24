from rankspark.llm import queries


def test_groups_have_every_recipe(spark, tmp_path):
    rows = [(1, "A b", "c d", None), (2, "a b", "c d", ""), (3, None, None, None), (4, "", " ", "!"), (4, "", " ", "!"), (5, "щи", None, None), (6, "x y z", None, None), (None, "x y z", None, None)]
    spark.createDataFrame(rows, "recipe_idx long, name string, ingredients string, description string").write.parquet(f"{tmp_path}/raw_recipes.parquet")
    got = sorted((r.recipe_idx, r.class_id, r.copies, r.links) for r in queries.p5_groups(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 2, 0), (2, 1, 2, 0), (3, 3, 1, 0), (4, 4, 1, 0), (5, 5, 1, 0), (6, 6, 1, 0)]
