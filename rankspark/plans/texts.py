"""Queries over text functions and chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import text as X
from rankspark.functions import stem
from rankspark.functions.stem import content_stems
from rankspark.functions.wordlists import CONTENT_STOPWORDS, SYNONYMS, TITLE_STOPWORDS
from rankspark.operators import chunking
from rankspark.operators.packed import split_packed
from rankspark.session import table

def searchable_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recipe").select("id", X.searchable_text(F.col("title"), F.col("ingredients"), F.col("description")).alias("content")).distinct()


def chunk_hash_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recipe_chunks").select("chunk_id", X.content_hash(F.col("chunk_text")).alias("text_hash"), X.word_count(F.col("chunk_text")).alias("token_count")).distinct()


def stale_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose stored word count isn't that of their text."""
    rows = table(spark, folder, "recipe_chunks").withColumn("actual", X.word_count(F.col("chunk_text")))
    return rows.filter(~F.col("actual").eqNullSafe(F.col("token_count"))).select("chunk_id", "token_count", "actual").distinct()


def field_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.field_chunks(table(spark, folder, "raw_recipes"), "recipe_idx", ["name", "ingredients", "description"]).distinct()


def full_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.full_chunks(table(spark, folder, "raw_recipes"), "recipe_idx", ["name", "ingredients"]).distinct()


def sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    groups = F.posexplode(chunking.sentence_groups(F.col("text"), 3)).alias("p", "content")
    return table(spark, folder, "documents").select("doc_id", groups).select("doc_id", (F.col("p") + 1).alias("position"), "content")


def fixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(chunking.word_budget(F.col("text"), 56)).alias("p", "content")).select("doc_id", (F.col("p") + 1).alias("position"), "content")


def semantic_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.semantic_chunks(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def assembled_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "recipe")
    return chunking.assemble(rows, "id", "title", F.col("description"), F.col("ingredients"), chunking.sentence_groups(F.col("directions"), 3)).distinct()


def title_body(spark: SparkSession, folder: str) -> DataFrame:
    title, body = X.title_and_body(F.col("chunk_text"))
    return table(spark, folder, "recipe_chunks").select("chunk_id", title.alias("title"), body.alias("body")).distinct()


def duration_parse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recipe").select("id", X.minutes_of(F.col("prep_text")).alias("minutes")).distinct()


def lenient_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Yields as numbers where they are, else null, with the bad ones counted by source."""
    number = X.lenient_number(F.regexp_replace("yields", " .*", ""))
    rows = table(spark, folder, "recipe").select("source", "yields", number.alias("n"))
    return rows.groupBy("source").agg(F.count_if(F.col("yields").isNotNull() & F.col("n").isNull()).alias("bad"), F.sum("n").alias("total"))


def fraction_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recipe").select("id", X.plain_fractions(F.col("ingredients")).alias("ingredients")).distinct()


def singular_terms(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "raw_recipes").select(F.explode(X.keywords(F.col("name"))).alias("word"))
    return words.select("word", X.singular(F.col("word")).alias("singular")).groupBy("word", "singular").agg(F.count("*").alias("n"))


def clean_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_recipes").select("recipe_idx", X.clean_description(F.col("description")).alias("description")).distinct()


def ingredient_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the values of each packed ingredients string; a recipe with several strings has the terms of each."""
    key = F.struct("recipe_idx", "dataset_revision", "ingredients")
    rows = table(spark, folder, "raw_recipes").select(key.alias("k"), F.concat(F.lit("raw:"), F.coalesce("dataset_revision", F.lit(""))).alias("s"), "ingredients")
    values = split_packed(rows, "k", "s", "ingredients").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("v"))
    terms = X.ingredient_terms(F.col("lines"))
    return values.select("key", stem.taken_apart(F.transform("v", lambda x: x["item"])).alias("lines")).select(F.col("key.recipe_idx").alias("recipe_idx"), F.posexplode(terms).alias("position", "term")).distinct()


def _recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded queries with the text of their source recipe."""
    records = table(spark, folder, "query_record").filter("query_text IS NOT NULL")
    recipes = table(spark, folder, "raw_recipes").groupBy("recipe_idx").agg(F.max(X.searchable_text(F.col("name"), F.col("ingredients"), F.col("description"))).alias("content"))
    return records.join(recipes, F.col("source_recipe_idx") == F.col("recipe_idx"))


def word_overlap_unstemmed(spark: SparkSession, folder: str) -> DataFrame:
    return _recorded(spark, folder).select("query_id", "query_text", X.word_overlap_unstemmed(F.col("query_text"), F.col("content")).alias("overlap")).distinct()


def word_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _recorded(spark, folder).select("query_id", "query_text", stem.word_overlap(F.col("query_text"), F.col("content")).alias("overlap")).distinct()


def index_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of the content words of the documents with the number of documents that have them."""
    terms = table(spark, folder, "documents").select(F.explode(F.array_distinct(content_stems(F.col("text")))).alias("stem"))
    return terms.groupBy("stem").agg(F.count("*").alias("df"))


def clean_generated(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded queries, and chunk texts as if a model had written them, cleaned."""
    said = F.concat(F.lit("\n Search: \n\""), "chunk_text", F.lit(".'"))
    texts = table(spark, folder, "query_record").select(F.col("query_text").alias("t")).unionByName(table(spark, folder, "recipe_chunks").select(said.alias("t")))
    return texts.filter("t IS NOT NULL").distinct().select("t", X.clean_generated(F.col("t")).alias("query"))


def generated_rejections(spark: SparkSession, folder: str) -> DataFrame:
    """Which recorded queries would be rejected as generated ones, and why."""
    records = table(spark, folder, "query_record").select("query_id", "source_recipe_idx", X.clean_generated(F.col("query_text")).alias("query")).distinct()
    names = table(spark, folder, "raw_recipes").groupBy(F.col("recipe_idx").alias("source_recipe_idx")).agg(F.max("name").alias("title"))
    return records.join(names, "source_recipe_idx").select("query_id", "query", X.generated_problem(F.col("query"), F.col("title")).alias("problem"))


def synonym_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Ingredient terms of each recipe with two words or more under other names, none of which its text begins a word with."""
    rows = table(spark, folder, "raw_recipes").select("recipe_idx", F.concat_ws(" ", "name", "ingredients", "description").alias("source")).distinct()
    terms = ingredient_terms(spark, folder).groupBy("recipe_idx").agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("t"))
    text, made = X.substitute_words(F.col("t.term"), SYNONYMS, F.col("source"))
    return rows.join(terms, "recipe_idx").select("recipe_idx", F.array_join(text, ", ").alias("query_text"), made.alias("substitutions")).filter(F.size("substitutions") >= 2)


NAMES = (
    "searchable_text chunk_hash_tokens stale_chunks field_chunks full_chunks sentence_chunks fixed_chunks semantic_chunks assembled_chunks title_body duration_parse lenient_numbers "
    "fraction_normalize singular_terms clean_descriptions ingredient_terms word_overlap_unstemmed word_overlap index_terms clean_generated generated_rejections synonym_queries"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_SQ = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_LIST = lambda words: "[" + ", ".join("'{}'".format(w.replace("'", "''")) for w in words) + "]"
_STOP, _TITLE_STOP = _LIST(CONTENT_STOPWORDS), _LIST(TITLE_STOPWORDS)
_CHUNK = f"sha256({_SQ.format('chunk_text')}) AS text_hash, CAST(len(list_filter(regexp_split_to_array(chunk_text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS token_count"
_SENTENCES = """list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\\s+([A-Z("''])', concat('\\1', chr(1), '\\2'), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"""
_GROUPS = "SELECT {k}, g + 1 AS position, array_to_string(s[g * 3 + 1 : g * 3 + 3], ' ') AS content FROM (SELECT {k}, s, unnest(range(0, CAST(ceil(len(s) / 3.0) AS BIGINT))) AS g FROM (SELECT {k}, " + _SENTENCES + " AS s FROM {t}))"


def _fractions(column: str) -> str:
    for sign, (over, under) in X.FRACTIONS.items():
        digits = f"{over}/{under}"
        column = f"regexp_replace(regexp_replace({column}, '([0-9])[ \\x{{a0}}\\x{{2009}}]?{sign}', '\\1 {digits}', 'g'), '{sign}', '{digits}', 'g')"
    return f"regexp_replace({column}, '[\\x{{a0}}\\x{{2009}}]', ' ', 'g')"


_KEYWORDS = "list_filter(regexp_extract_all(lower(regexp_replace({}, '\\([^)]*\\)', ' ', 'g')), '[a-z][a-z''\\-]*'), lambda w: len(w) > 1 AND NOT list_contains(" + _TITLE_STOP + ", w) AND NOT regexp_matches(w, '" + X.ROMAN.replace("{0,3}", "{{0,3}}") + "'))"
_LINE = "list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\r\\n\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_replace(regexp_replace(x, '(?i)^\\s*search:\\s*', ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1]"
ORACLES = {
    "searchable_text": f"SELECT DISTINCT id, concat_ws(' ', nullif({_SQ.format('title')}, ''), nullif({_SQ.format('ingredients')}, ''), nullif({_SQ.format('description')}, '')) AS content FROM recipe",
    "chunk_hash_tokens": f"SELECT DISTINCT chunk_id, {_CHUNK} FROM recipe_chunks",
    "stale_chunks": "SELECT DISTINCT chunk_id, token_count, actual FROM (SELECT chunk_id, token_count, CAST(len(list_filter(regexp_split_to_array(chunk_text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS actual FROM recipe_chunks) WHERE token_count IS DISTINCT FROM actual",
    "field_chunks": f"SELECT DISTINCT key, field_name, chunk_text, 0 AS chunk_index, {_CHUNK} FROM (SELECT key, field_name, {_SQ.format('t')} AS chunk_text FROM (SELECT recipe_idx AS key, unnest(['name', 'ingredients', 'description']) AS field_name, unnest([name, ingredients, description]) AS t FROM raw_recipes)) WHERE chunk_text <> ''",
    "full_chunks": f"SELECT DISTINCT key, '' AS field_name, chunk_text, 0 AS chunk_index, {_CHUNK} FROM (SELECT recipe_idx AS key, concat_ws(' ', nullif({_SQ.format('name')}, ''), nullif({_SQ.format('ingredients')}, '')) AS chunk_text FROM raw_recipes) WHERE chunk_text <> ''",
    "sentence_chunks": _GROUPS.format("text", k="doc_id", t="documents").replace("g + 1 AS position", "CAST(g + 1 AS INTEGER) AS position"),
    "title_body": "SELECT DISTINCT chunk_id, split_part(chunk_text, chr(10), 1) AS title, CASE WHEN instr(chunk_text, chr(10)) > 0 THEN substr(chunk_text, instr(chunk_text, chr(10)) + 1) ELSE '' END AS body FROM recipe_chunks",
    "duration_parse": r"""SELECT DISTINCT id, CAST(CASE WHEN len(f) > 0 THEN list_sum(list_transform(f, lambda p: CAST(regexp_extract(p, '^([0-9]+)', 1) AS INTEGER) * CASE regexp_extract(p, '([a-z])[a-z]*$', 1) WHEN 'd' THEN 1440 WHEN 'h' THEN 60 ELSE 1 END)) END AS INTEGER) AS minutes
        FROM (SELECT id, regexp_extract_all(lower(prep_text), '[0-9]+\s*(?:days?|hours?|hrs?|mins?|minutes?)\b') AS f FROM recipe)""",
    "lenient_numbers": "SELECT source, count(*) FILTER (yields IS NOT NULL AND n IS NULL) AS bad, sum(n) AS total FROM (SELECT source, yields, TRY_CAST(nullif(trim(regexp_replace(yields, ' .*', '')), '') AS DOUBLE) AS n FROM recipe) GROUP BY source",
    "fraction_normalize": f"SELECT DISTINCT id, {_fractions('ingredients')} AS ingredients FROM recipe",
    "singular_terms": f"""SELECT word, CASE WHEN len(word) <= 3 THEN word WHEN word LIKE '%ies' THEN regexp_replace(word, 'ies$', 'y') WHEN word LIKE '%oes' THEN regexp_replace(word, 'oes$', 'o')
        WHEN regexp_matches(word, '(?:ss|us|is)$') THEN word ELSE regexp_replace(word, 's$', '') END AS singular, count(*) AS n FROM (SELECT unnest({_KEYWORDS.format('name')}) AS word FROM raw_recipes) GROUP BY ALL""",
    "clean_descriptions": f"""SELECT DISTINCT recipe_idx, {_SQ.format("regexp_replace(" + _SQ.format('description') + ", '^[''" + '"' + "]+|[''" + '"' + "]+$', '', 'g')")} AS description FROM raw_recipes""",
    "clean_generated": f"""SELECT t, regexp_replace(regexp_replace(regexp_replace(coalesce({_LINE}, ''), '^["''`“”]+|["''`“”]+$', '', 'g'), '\\.+$', ''), '^\\s+|\\s+$', '', 'g') AS query
        FROM (SELECT query_text AS t FROM query_record UNION SELECT concat(chr(10), ' Search: ', chr(10), '"', chunk_text, '.', chr(39)) FROM recipe_chunks WHERE chunk_text IS NOT NULL) WHERE t IS NOT NULL""",
    "word_overlap_unstemmed": f"""WITH r AS (SELECT recipe_idx, max(concat_ws(' ', nullif({_SQ.format('name')}, ''), nullif({_SQ.format('ingredients')}, ''), nullif({_SQ.format('description')}, ''))) AS content FROM raw_recipes GROUP BY 1),
        t AS (SELECT DISTINCT query_id, query_text, list_filter(regexp_extract_all(translate(lower(query_text), '{X.ACCENTED}', '{X.PLAIN}'), '[a-z]+'), lambda w: NOT list_contains({_STOP}, w)) AS q,
              list_filter(regexp_extract_all(translate(lower(content), '{X.ACCENTED}', '{X.PLAIN}'), '[a-z]+'), lambda w: NOT list_contains({_STOP}, w)) AS d
              FROM query_record JOIN r ON source_recipe_idx = recipe_idx WHERE query_text IS NOT NULL)
        SELECT query_id, query_text, CASE WHEN len(q) > 0 THEN round(len(list_filter(q, lambda w: list_contains(d, w))) / len(q), 3) ELSE 0.0 END AS overlap FROM t""",
}
