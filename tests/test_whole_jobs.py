"""Queries do the whole job: cases that a part of the table, or of a string, would get wrong."""

import json

from conftest import same_as_oracle
from rankspark.operators import retrieval
from rankspark.plans import lifecycle, search, texts


def write(spark, folder, **tables):
    """Small Parquet tables, each given as (schema, rows)."""
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ingredient_terms_of_every_packing(spark, tmp_path):
    values = ["2 cups brown rice", "1 tsp salt (fine)", "3 large eggs", "Topping:", "1 oz hard cheese"]
    packed = [s.join(values) for s in ("\n", "\r\n", "\t", "; ", " | ", " · ", " • ", ",")] + [json.dumps(values)]
    commas = ["2 cups rice, washed; 1 tsp salt, fine"]  # the comma ends a value only where nothing else separates
    rows = [(i, p, "r") for i, p in enumerate([*packed, *commas])] + [(0, "5 plums; 1 kg figs", "q"), (50, None, "r"), (51, " ", "r")]
    folder = write(spark, tmp_path, raw_recipes=("recipe_idx long, ingredients string, dataset_revision string", rows + rows))
    got = {}
    for r in texts.ingredient_terms(spark, folder).collect():
        got.setdefault(r.recipe_idx, []).append((r.position, r.term))
    terms = list(enumerate(["brown rice", "salt", "eggs", "hard cheese"]))
    assert sorted(got.pop(0)) == sorted([*terms, (0, "plums"), (1, "figs")])
    assert {k: sorted(v) for k, v in got.items()} == {i: terms for i in range(1, len(packed))} | {len(packed): [(0, "rice"), (1, "salt")]}


def test_ordered_aggregates_of_every_profile(spark, small):
    sql = """SELECT profile_id, recipe_idx, list(chunk_text ORDER BY chunk_id) AS lines, string_agg(chunk_text, '; ' ORDER BY chunk_id) AS text
        FROM (SELECT DISTINCT profile_id, recipe_idx, chunk_id, chunk_text FROM recipe_chunks) GROUP BY ALL"""
    same_as_oracle(spark, small, lifecycle.QUERIES["ordered_aggregates_profiles"], sql)


def test_collapse_keeps_recipes_behind_one_of_many_chunks(spark):
    chunks = spark.createDataFrame([(c, 0) for c in range(100)] + [(100 + r, r) for r in range(1, 15)], "chunk long, item long")
    hits = chunks.selectExpr("1L AS query_id", "chunk AS key", "IF(item = 0, 9.0D, 5.0D - item / 10) AS score")
    assert [r.item for r in retrieval.collapse(hits, chunks, "chunk", "item", 10).orderBy("rank").collect()] == list(range(10))
    assert [r.item for r in retrieval.collapse(hits, chunks, "chunk", "item", 10, overfetch=5).collect()] == [0]


def test_bm25_recipes_of_every_profile(spark, small):
    docs = "SELECT DISTINCT chunk_id AS key, profile_id AS scope, chunk_text AS text FROM recipe_chunks"
    sql = search._bm25(docs) + """, items AS (SELECT query_id, profile_id, recipe_idx, max(score) AS score FROM hits JOIN (SELECT DISTINCT chunk_id AS key, profile_id, recipe_idx FROM recipe_chunks) USING (key) GROUP BY ALL)
        SELECT query_id, profile_id, CAST(rank AS INTEGER) AS rank, recipe_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, profile_id ORDER BY score DESC, recipe_idx) AS rank FROM items) WHERE rank <= 10"""
    same_as_oracle(spark, small, search.QUERIES["bm25_recipe_max_collapse_profiles"], sql)


def test_items_are_those_of_all_hits(spark):
    """One item has a third of the documents; documents of equal score; two scopes."""
    rows = [(d, 0 if d % 3 == 0 else d % 40, d % 2, "red " * (1 + d % 4) + "soup " * (d % 5) + f"w{d % 7}") for d in range(300)]
    docs = spark.createDataFrame(rows, "doc long, item long, scope long, text string")
    terms = retrieval.query_terms(spark.createDataFrame([(1, "red soup"), (2, "w3 soup"), (3, "w9")], "q long, text string"), "q", "text")
    got = {(r.query_id, r.scope, r["rank"], r.item, r.score) for r in retrieval.bm25_items(docs, terms, "doc", "text", "item", "scope", 10).collect()}
    hits = retrieval.bm25_scores(docs, terms, "doc", "text", scope="scope").join(docs.selectExpr("doc AS key", "scope"), "key")
    expected = retrieval.collapse(hits, docs, "doc", "item", 10, by=["query_id", "scope"])
    assert got == {(r.query_id, r.scope, r["rank"], r.item, r.score) for r in expected.collect()} and len(got) == 40


def test_families_have_recipes_that_can_make_a_query(spark, tmp_path):
    rows = [(i, f"Meal{i}", f"1 cup plain rice; {i} eggs", "A meal%d of the." % i) for i in range(100)]
    rows += [(200 + i, f"Dish{i}", "1 cup onions; 2 cups butter; 3 cups ginger; 1 cup plain rice", "one two three four five") for i in range(4)]
    rows += [(300 + i, f"Dish{i}", "1 cup onions; 2 cups butter; 3 cups ginger; 2 shallots", None) for i in range(2)]  # shallots are in the source: 1 substitution
    folder = write(spark, tmp_path, raw_recipes=("recipe_idx long, name string, ingredients string, description string, dataset_revision string", [(*r, "r") for r in rows]))
    every = {"ingredient_combo": set(range(200, 204)) | {300, 301}, "desc_short": set(), "synonym_hard": set()}
    got = {f: {r.recipe_idx for r in lifecycle.query_families(spark, folder).collect() if r.family == f} for f in every}
    assert got == every
    del rows[100:]
    rows += [(400, "Soup", None, "one two three of soups four the")]
    other = write(spark, tmp_path / "b", raw_recipes=("recipe_idx long, name string, ingredients string, description string, dataset_revision string", [(*r, "r") for r in rows]))
    assert [(r.family, r.recipe_idx) for r in lifecycle.query_families(spark, other).collect()] == [("desc_short", 400)]


def test_tail_follows_what_was_loaded(spark, tmp_path):
    rows = [(i, f"n{i}", "old", 1) for i in range(900)] + [(i * 2, f"m{i}", "new", 2) for i in range(400)]
    folder = write(spark, tmp_path, raw_recipes=("recipe_idx long, name string, dataset_revision string, updated_at int", rows + rows))
    got = sorted((r.recipe_idx, r.name) for r in lifecycle.delete_tail_loaded(spark, folder).collect())
    assert got == sorted((k, n) for k, n, _, _ in rows if k < 400)
