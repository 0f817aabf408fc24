"""Data lifecycle and query-set queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankspark.functions import text as X
from rankspark.functions.wordlists import PREP_WORDS, STAPLE_WORDS, SYNONYMS
from rankspark.operators import ingest as I
from rankspark.operators import querygen as Q
from rankspark.operators.packed import split_packed
from rankspark.plans.texts import _KEYWORDS, ingredient_terms
from rankspark.session import table


def ingest_first_url_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "recipe").filter("url IS NOT NULL")
    return I.first_wins(rows, ["url"], [F.asc("loaded_at"), F.asc("id")]).select("url", "id", "title")


def dims_numbered(spark: SparkSession, folder: str) -> DataFrame:
    return I.dense_ids(table(spark, folder, "recipe"), "title", "title_id")


def ingest_3nf(spark: SparkSession, folder: str) -> DataFrame:
    """Ingredient lines of the first recipe of each URL, with its category and position."""
    first = ingest_first_url_wins(spark, folder).select("id").join(table(spark, folder, "recipe").select("id", "category_id", "source", "ingredients").distinct(), "id")
    lines = split_packed(first, "id", "source", "ingredients")
    return first.select("id", "category_id").join(lines.withColumnRenamed("key", "id"), "id")


def ordered_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk texts of a recipe in order, as one string and as an array."""
    rows = table(spark, folder, "recipe_chunks").filter("profile_id = 3").select("recipe_idx", "chunk_id", "chunk_text").distinct()
    return I.ordered_text(rows, "recipe_idx", "chunk_id", "chunk_text")


def ordered_aggregates_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """As ordered_aggregates, which is profile 3 alone, for each profile: profile_id, recipe_idx, lines, text."""
    key = F.struct("profile_id", "recipe_idx").alias("k")
    rows = table(spark, folder, "recipe_chunks").select(key, "chunk_id", "chunk_text").distinct()
    return I.ordered_text(rows, "k", "chunk_id", "chunk_text").select("k.profile_id", "k.recipe_idx", "lines", "text")


def upsert_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the first revision, replaced or joined by the last row of each recipe of the second."""
    rows = table(spark, folder, "raw_recipes").select("recipe_idx", "name", "dataset_revision", "updated_at")
    old = I.first_wins(rows.filter("dataset_revision = '3f9a1c7e'"), ["recipe_idx"], [F.asc("updated_at")])
    new = I.first_wins(rows.filter("dataset_revision = 'b07d22e1'"), ["recipe_idx"], [F.desc("updated_at")])
    return I.upsert(old, new, ["recipe_idx"])


def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "raw_recipes").select("recipe_idx").distinct()
    return I.insert_absent(known, table(spark, folder, "recipe_chunks").select("recipe_idx").distinct(), ["recipe_idx"])


def delete_tail(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_recipes").filter("recipe_idx < 300").select("recipe_idx", "name").distinct()


def delete_tail_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """As delete_tail, whose bound is 300, with the number of recipes of the revision that was loaded last as the bound."""
    rows = table(spark, folder, "raw_recipes")
    last = rows.agg(F.max_by("dataset_revision", F.struct("updated_at", "dataset_revision")).alias("dataset_revision"))
    bound = rows.join(F.broadcast(last), "dataset_revision").agg(F.countDistinct("recipe_idx").alias("bound"))  # one row each
    return rows.join(F.broadcast(bound), F.col("recipe_idx") < F.col("bound")).select("recipe_idx", "name").distinct()


def stale_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that point to no recipe."""
    return table(spark, folder, "recipe_chunks").join(table(spark, folder, "raw_recipes").select("recipe_idx"), "recipe_idx", "left_anti").select("chunk_id", "recipe_idx").distinct()


def chunks_kept(spark: SparkSession, folder: str) -> DataFrame:
    return I.delete_stale(table(spark, folder, "recipe_chunks"), table(spark, folder, "raw_recipes"), ["recipe_idx"]).groupBy("profile_id").agg(F.count("*").alias("chunks"))


def _hashes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "recipe_chunks")
    return rows.select("chunk_id", F.sha2("chunk_text", 256).alias("text_hash")).distinct(), rows.select("chunk_id", "text_hash").distinct()


def incremental_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose text isn't the one that their stored hash says was worked on."""
    return I.pending(*_hashes(spark, folder), ["chunk_id", "text_hash"])


def symmetric_difference(spark: SparkSession, folder: str) -> DataFrame:
    return I.symmetric_difference(*_hashes(spark, folder)).groupBy("chunk_id").agg(F.count("*").alias("n"))


def consistency_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Recipes whose copies in the two recipe tables differ in title or image."""
    a = table(spark, folder, "recipe").select(F.col("id").cast("bigint").alias("k"), "title", "image_url").distinct()
    b = table(spark, folder, "raw_recipes").select((F.col("recipe_idx") + 1).alias("k"), F.col("name").alias("title"), F.col("image_path").alias("image_url")).distinct()
    return I.differing(a, b, ["k"], ["title", "image_url"])


def staging_checks(spark: SparkSession, folder: str) -> DataFrame:
    return I.staging_problems(table(spark, folder, "recipe_chunks"), table(spark, folder, "raw_recipes"), "profile_id", "recipe_idx", "chunk_text", "chunk_index")


def profiles_in_use(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunk_profiles").join(table(spark, folder, "recipe_chunks"), "profile_id", "left_semi").select("profile_id", "profile_name", F.get_json_object("config", "$.note").alias("note"))


def recipes_without_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per recipe by an outer join: recipes without chunks count 0."""
    counts = table(spark, folder, "recipe_chunks").groupBy("recipe_idx").agg(F.count("*").alias("n"))
    rows = table(spark, folder, "raw_recipes").select("recipe_idx", "dataset_split").distinct().join(counts, "recipe_idx", "left")
    return rows.groupBy("dataset_split").agg(F.count("*").alias("recipes"), F.count_if(F.col("n").isNull()).alias("without"), F.sum(F.coalesce("n", F.lit(0))).alias("chunks"))


def source_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, text lengths and late rows by source."""
    late = F.col("ingested_at") > F.col("crawled_at") + F.expr("INTERVAL 1 DAY")
    return table(spark, folder, "documents").groupBy("source").agg(
        F.count("*").alias("documents"), F.countDistinct("text").alias("texts"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.count_if(late).alias("late"),
        F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"),
    )


def order_values(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue and orders by nation: joins over the star schema."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def stratified_quota(spark: SparkSession, folder: str) -> DataFrame:
    return Q.stratified_quotas(table(spark, folder, "recipe").select("id", "category_id").distinct(), "category_id", 120).select("category_id", "size", F.col("quota").cast("bigint").alias("quota"))


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return Q.stratified_sample(table(spark, folder, "recipe").select("id", "category_id").distinct(), "id", "category_id", 120)


def rare_term_selection(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "raw_recipes").select("recipe_idx", F.explode(X.keywords(F.col("name"))).alias("term"))
    return Q.rare_terms(terms, "recipe_idx", "term").select("recipe_idx", "term", "df", F.col("place").cast("int").alias("place"))


def jaccard_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Different recorded queries with nearly the same terms."""
    sets = table(spark, folder, "query_record").filter("query_text IS NOT NULL").select("query_text", X.tokens(F.col("query_text")).alias("terms"))
    return Q.similar_term_sets(sets, "query_text", "terms").select("key_a", "key_b", F.col("both").cast("bigint").alias("both"), F.round("similarity", 6).alias("similarity"))


def _query_texts(spark: SparkSession, folder: str, staples: list[str]) -> dict[str, DataFrame]:
    """For each family, the query of every recipe of which one can be made: recipe_idx, query_text, base_text, substitutions.

    Ingredient terms of nothing but staples and words of preparation don't count.
    """
    rows = table(spark, folder, "raw_recipes").select("recipe_idx", "name", "ingredients", "description").distinct()
    rows = I.first_wins(rows, ["recipe_idx"], [F.desc_nulls_last("name"), F.desc_nulls_last("ingredients"), F.desc_nulls_last("description")])
    terms = ingredient_terms(spark, folder).select("recipe_idx", "term", X.normal_term(F.col("term")).alias("key"))
    df = terms.select("recipe_idx", "key").distinct().groupBy("key").agg(F.count("*").alias("df"))
    total = rows.agg(F.count("*").alias("total"))
    staple = F.forall(F.split("key", " "), lambda w: w.isin(*staples, *PREP_WORDS))
    kept = df.join(F.broadcast(total)).filter((F.col("df") >= 2) & (F.col("df") <= 0.10 * F.col("total")) & ~staple).select("key", "df")  # total is one row
    place = F.row_number().over(Window.partitionBy("recipe_idx").orderBy("df", "term"))
    rare = terms.join(kept, "key").select("recipe_idx", "term", "df").distinct().withColumn("place", place).filter("place <= 4")
    rare = rare.groupBy("recipe_idx").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t")).filter(F.size("t") >= 3).select("recipe_idx", F.col("t.term").alias("t"))

    def made_of(df: DataFrame, text: Column, base: Column | None = None, made: Column | None = None) -> DataFrame:
        none = F.array().cast("array<string>")
        return df.select("recipe_idx", text.alias("query_text"), (F.lit("") if base is None else base).alias("base_text"), (none if made is None else made).alias("substitutions"))

    short, named = X.short_description(F.col("description"), F.col("name")), X.keywords(F.col("name"))
    swapped, made = X.substitute_words(F.col("t"), SYNONYMS, F.concat_ws(" ", "name", "ingredients", "description"))
    return {
        "name_kw": made_of(rows.filter(F.size(named) >= 2), F.array_join(named, " ")), "ingredient_combo": made_of(rare, F.array_join("t", ", ")),
        "desc_short": made_of(rows.filter(F.size(short) >= 4), F.array_join(short, " ")),
        "synonym_hard": made_of(rows.join(rare, "recipe_idx"), F.array_join(swapped, ", "), F.array_join("t", ", "), made).filter(F.size("substitutions") >= 2),
    }


def query_families(spark: SparkSession, folder: str) -> DataFrame:
    """Source recipes for four families of queries, each used once and only where such a query can be made of it.

    name_kw: 2 keywords of the name; ingredient_combo: 3 to 4 of the rarest ingredient terms; desc_short: 4 to 12 words of the description
    besides those of the name; synonym_hard: 2 substitutions in such ingredient terms. A family may have fewer than 75.
    Staples count as ingredients here; query_set leaves them out.
    """
    return Q.disjoint_families(_query_texts(spark, folder, []), "recipe_idx", 75)


def query_set(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of the families of query_families, staples left out, with their texts: query_id, family, recipe_idx, query_text, base_text, substitutions."""
    texts = _query_texts(spark, folder, STAPLE_WORDS)
    every = None
    for family, rows in texts.items():
        own = rows.withColumn("family", F.lit(family))
        every = own if every is None else every.unionByName(own)
    picked = Q.disjoint_families(texts, "recipe_idx", 75).join(every, ["family", "recipe_idx"])
    place = F.row_number().over(Window.partitionBy("family").orderBy("recipe_idx"))  # at most 75 a family
    return picked.withColumn("query_id", F.concat("family", F.lit("_"), F.lpad(place.cast("string"), 3, "0")))


NAMES = (
    "ingest_first_url_wins dims_numbered ingest_3nf ordered_aggregates ordered_aggregates_profiles upsert_recipes insert_if_absent delete_tail delete_tail_loaded stale_anti_join chunks_kept incremental_pending symmetric_difference consistency_mismatch "
    "staging_checks profiles_in_use recipes_without_chunks source_profile order_values stratified_quota stratified_sample rare_term_selection jaccard_near_dup query_families query_set"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
_HASH = "SELECT DISTINCT chunk_id, sha256(chunk_text) AS text_hash FROM recipe_chunks"
_OLD = "SELECT DISTINCT chunk_id, text_hash FROM recipe_chunks"
_TERMS = f"SELECT DISTINCT recipe_idx, unnest({_KEYWORDS.format('name')}) AS term FROM raw_recipes"
ORACLES = {
    "ingest_first_url_wins": "SELECT DISTINCT ON (url) url, id, title FROM recipe WHERE url IS NOT NULL ORDER BY url, loaded_at, id",
    "dims_numbered": "SELECT title, row_number() OVER (ORDER BY title) AS title_id FROM (SELECT DISTINCT title FROM recipe WHERE title IS NOT NULL)",
    "ordered_aggregates": "SELECT recipe_idx, list(chunk_text ORDER BY chunk_id) AS lines, string_agg(chunk_text, '; ' ORDER BY chunk_id) AS text FROM (SELECT DISTINCT recipe_idx, chunk_id, chunk_text FROM recipe_chunks WHERE profile_id = 3) GROUP BY recipe_idx",
    "upsert_recipes": """WITH r AS (SELECT recipe_idx, name, dataset_revision, updated_at FROM raw_recipes),
        o AS (SELECT DISTINCT ON (recipe_idx) * FROM r WHERE dataset_revision = '3f9a1c7e' ORDER BY recipe_idx, updated_at), n AS (SELECT DISTINCT ON (recipe_idx) * FROM r WHERE dataset_revision = 'b07d22e1' ORDER BY recipe_idx, updated_at DESC)
        SELECT * FROM o WHERE recipe_idx NOT IN (SELECT recipe_idx FROM n) UNION ALL SELECT * FROM n""",
    "insert_if_absent": "SELECT recipe_idx FROM raw_recipes UNION SELECT recipe_idx FROM recipe_chunks",
    "delete_tail": "SELECT DISTINCT recipe_idx, name FROM raw_recipes WHERE recipe_idx < 300",
    "stale_anti_join": "SELECT DISTINCT chunk_id, recipe_idx FROM recipe_chunks c WHERE NOT EXISTS (SELECT 1 FROM raw_recipes r WHERE r.recipe_idx = c.recipe_idx)",
    "chunks_kept": "SELECT profile_id, count(*) AS chunks FROM recipe_chunks c WHERE EXISTS (SELECT 1 FROM raw_recipes r WHERE r.recipe_idx = c.recipe_idx) GROUP BY profile_id",
    "incremental_pending": f"{_HASH} EXCEPT {_OLD}",
    "symmetric_difference": f"SELECT chunk_id, count(*) AS n FROM (({_HASH} EXCEPT {_OLD}) UNION ALL ({_OLD} EXCEPT {_HASH})) GROUP BY chunk_id",
    "consistency_mismatch": "SELECT k FROM (SELECT DISTINCT CAST(id AS BIGINT) AS k, title, image_url FROM recipe) a JOIN (SELECT DISTINCT recipe_idx + 1 AS k, name, image_path FROM raw_recipes) b USING (k) WHERE (title, image_url) IS DISTINCT FROM (name, image_path)",
    "staging_checks": """WITH g AS (SELECT profile_id, recipe_idx, field_name, min(chunk_index) AS a, max(chunk_index) AS z, count(DISTINCT chunk_index) AS d FROM recipe_chunks GROUP BY ALL)
        SELECT profile_id, rows, items, empty, "unknown", longest, gaps FROM (SELECT profile_id, count(*) AS rows, count(DISTINCT recipe_idx) AS items, count(*) FILTER (trim(coalesce(chunk_text, '')) = '') AS empty,
          count(*) FILTER (recipe_idx NOT IN (SELECT recipe_idx FROM raw_recipes)) AS "unknown", max(length(chunk_text))::INTEGER AS longest FROM recipe_chunks GROUP BY profile_id)
        JOIN (SELECT profile_id, count(*) FILTER (a <> 0 OR z <> d - 1) AS gaps FROM g GROUP BY profile_id) USING (profile_id)""",
    "profiles_in_use": "SELECT profile_id, profile_name, json_extract_string(config, '$.note') AS note FROM chunk_profiles WHERE profile_id IN (SELECT profile_id FROM recipe_chunks)",
    "recipes_without_chunks": """SELECT dataset_split, count(*) AS recipes, count(*) FILTER (n IS NULL) AS without, CAST(sum(coalesce(n, 0)) AS BIGINT) AS chunks FROM (SELECT DISTINCT recipe_idx, dataset_split FROM raw_recipes)
        LEFT JOIN (SELECT recipe_idx, count(*) AS n FROM recipe_chunks GROUP BY 1) USING (recipe_idx) GROUP BY dataset_split""",
    "source_profile": "SELECT source, count(*) AS documents, count(DISTINCT text) AS texts, count(*) FILTER (text IS NULL) AS null_texts, count(*) FILTER (ingested_at > crawled_at + INTERVAL 1 DAY) AS late, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source",
    "order_values": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "stratified_quota": """WITH s AS (SELECT category_id, count(*) AS size FROM (SELECT DISTINCT id, category_id FROM recipe) GROUP BY 1), t AS (SELECT *, 120 * size // (SELECT sum(size) FROM s) AS q, 120 * size % (SELECT sum(size) FROM s) AS rest FROM s)
        SELECT category_id, size, CAST(q + CASE WHEN row_number() OVER (ORDER BY rest DESC, category_id) <= 120 - (SELECT sum(q) FROM t) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM t""",
    "rare_term_selection": f"""WITH t AS ({_TERMS}), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), k AS (SELECT * FROM d WHERE df >= 2 AND df <= 0.1 * (SELECT count(DISTINCT recipe_idx) FROM t))
        SELECT recipe_idx, term, df, CAST(place AS INTEGER) AS place FROM (SELECT recipe_idx, term, df, row_number() OVER (PARTITION BY recipe_idx ORDER BY df, term) AS place FROM t JOIN k USING (term)) WHERE place <= 4""",
    "jaccard_near_dup": """WITH s AS (SELECT query_text, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS t FROM (SELECT DISTINCT query_text FROM query_record WHERE query_text IS NOT NULL)), e AS (SELECT query_text, len(t) AS n, unnest(t) AS term FROM s WHERE len(t) >= 3),
        c AS (SELECT a.query_text AS key_a, b.query_text AS key_b, a.n AS na, b.n AS nb, count(*) AS common FROM e a JOIN e b ON a.term = b.term AND a.query_text < b.query_text GROUP BY ALL)
        SELECT key_a, key_b, common AS "both", round(common / (na + nb - common), 6) AS similarity FROM c WHERE common / (na + nb - common) >= 0.8""",
}
