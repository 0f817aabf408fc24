"""The queries of the llm operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import abuse, bpe, leak, neardup, split, topn

#: Where the public vocabularies lie; a parameter of the queries that use one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    best = topn.top_n(_table(spark, folder, "candidate"), "query_id", "recipe_id", "score", 10)
    return best.select(F.col("group_key").alias("query_id"), F.col("rank_no").cast("int").alias("rank_no"), F.col("item").alias("recipe_id"))


def p1_lists(spark: SparkSession, folder: str) -> DataFrame:
    """ranked_ids and top_scores as a query_record should hold them."""
    return topn.top_lists(_table(spark, folder, "candidate"), "query_id", "recipe_id", "score", 10).withColumnRenamed("group_key", "query_id")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    profiles = _table(spark, folder, "chunk_profiles").select("profile_id", "chunk_size", "chunk_overlap")
    return _table(spark, folder, "recipe_chunks").select("chunk_id", "profile_id", "chunk_text").join(profiles, "profile_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized(_chunks(spark, folder), "chunk_id", "chunk_text", "chunk_size", "chunk_overlap").withColumnRenamed("key", "chunk_id")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk as pieces within its profile's chunk_size."""
    return split.split_oversized(_chunks(spark, folder), "chunk_id", "chunk_text", "chunk_size", "chunk_overlap").withColumnRenamed("key", "chunk_id")


RECIPE_TEXTS = ["name", "ingredients", "description"]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.similar_pairs(_table(spark, folder, "raw_recipes"), "recipe_idx", RECIPE_TEXTS, 0.7)
    return pairs.select(F.col("key_a").alias("recipe_idx_a"), F.col("key_b").alias("recipe_idx_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per recipe_idx, wordless ones too, with its class of near-duplicates."""
    return neardup.every_class(_table(spark, folder, "raw_recipes"), "recipe_idx", RECIPE_TEXTS, 0.7).withColumnRenamed("key", "recipe_idx")


def p6_ids(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return bpe.encode_corpus(_table(spark, folder, "documents"), bpe.read_ranks(vocabulary)).withColumnRenamed("key", "doc_id")


def p6_round_trip(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each source: documents, and how many of their texts come back from their ids (null as empty)."""
    documents, ranks = _table(spark, folder, "documents"), bpe.read_ranks(vocabulary)
    both = F.struct("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    ids = bpe.encode_corpus(documents.select(both.alias("k"), F.col("text")), ranks, "k")
    same = (bpe.decode_ids(F.col("ids"), ranks) == F.col("key.text")).cast("int")
    return ids.groupBy(F.col("key.source").alias("source")).agg(F.count("*").alias("documents"), F.sum(same).alias("same"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = leak.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), near=False)
    return leaks.filter("copied").select(F.col("key").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Copied and nearly copied passages: how many windows of the document match the item, and how well."""
    leaks = leak.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return leaks.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score and the offsets of what offends in it."""
    documents = _table(spark, folder, "documents")
    field = abuse.fit(documents, _table(spark, folder, "labels"))
    return abuse.score_documents(documents, field).withColumnRenamed("key", "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """For each source: documents, abusive ones, and their share."""
    documents = _table(spark, folder, "documents")
    field = abuse.fit(documents, _table(spark, folder, "labels"))
    scored = abuse.score_documents(documents, field)
    sources = documents.select(F.col("doc_id").alias("key"), "source").distinct()
    bad = F.count_if(F.col("score") >= abuse.THRESHOLD)
    rated = scored.select("key", "score").join(sources, "key").groupBy("source").agg(F.count("*").alias("documents"), bad.alias("abusive"))
    return rated.withColumn("rate", F.col("abusive") / F.col("documents"))


QUERIES = {"p1_found": p1_found, "p1_lists": p1_lists, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_groups": p5_groups, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}

ORACLES = {
    "p5_found": """
        WITH w AS (SELECT recipe_idx, list_distinct(regexp_extract_all(lower(concat_ws(' ', first(name), first(ingredients), first(description))), '[a-z0-9]+')) AS words
                   FROM raw_recipes GROUP BY recipe_idx),
             e AS (SELECT recipe_idx, len(words) AS n, unnest(words) AS word FROM w),
             c AS (SELECT a.recipe_idx AS recipe_idx_a, b.recipe_idx AS recipe_idx_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
                   FROM e a JOIN e b ON a.word = b.word AND a.recipe_idx < b.recipe_idx GROUP BY ALL)
        SELECT recipe_idx_a, recipe_idx_b FROM c WHERE common / (na + nb - common) >= 0.7""",
    "p5_groups": """
        WITH RECURSIVE m AS (SELECT DISTINCT recipe_idx, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', name, ingredients, description)), '[a-z0-9]+'))), ' ') AS s
                             FROM raw_recipes WHERE recipe_idx IS NOT NULL),
             e AS (SELECT s, len(string_split(s, ' ')) AS n, unnest(string_split(s, ' ')) AS word FROM (SELECT DISTINCT s FROM m WHERE s <> '')),
             c AS (SELECT a.s AS x, b.s AS y FROM e a JOIN e b ON a.word = b.word AND a.s <> b.s GROUP BY a.s, b.s HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.7),
             l AS (SELECT a.recipe_idx AS x, b.recipe_idx AS y FROM m a JOIN m b USING (s) WHERE s <> '' UNION SELECT a.recipe_idx, b.recipe_idx FROM c JOIN m a ON a.s = c.x JOIN m b ON b.s = c.y),
             r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
             k AS (SELECT s, count(*) AS copies FROM m WHERE s <> '' GROUP BY s), d AS (SELECT x AS s, count(*) AS links FROM c GROUP BY x),
             o AS (SELECT recipe_idx, max(copies) AS copies, CAST(sum(coalesce(links, 0)) AS BIGINT) AS links FROM m LEFT JOIN k USING (s) LEFT JOIN d USING (s) GROUP BY recipe_idx)
        SELECT recipe_idx, coalesce(class_id, recipe_idx) AS class_id, coalesce(copies, 1) AS copies, links FROM o LEFT JOIN (SELECT x AS recipe_idx, min(y) AS class_id FROM r GROUP BY x) USING (recipe_idx)""",
    "p6_round_trip": "SELECT source, count(*) AS documents, count(*) AS same FROM documents GROUP BY source",
    "p1_found": """
        SELECT query_id, CAST(rank_no AS INTEGER) AS rank_no, recipe_id FROM (
            SELECT query_id, recipe_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recipe_id) AS rank_no
            FROM (SELECT query_id, recipe_id, max(score) AS score FROM candidate
                  WHERE score IS NOT NULL AND NOT isnan(score) AND recipe_id IS NOT NULL GROUP BY ALL))
        WHERE rank_no <= 10""",
    "p1_lists": """
        SELECT query_id, list(recipe_id ORDER BY rank_no) AS ranked_ids, list(score ORDER BY rank_no) AS top_scores FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recipe_id) AS rank_no
            FROM (SELECT query_id, recipe_id, max(score) AS score FROM candidate
                  WHERE score IS NOT NULL AND NOT isnan(score) AND recipe_id IS NOT NULL GROUP BY ALL))
        WHERE rank_no <= 10 GROUP BY query_id""",
    "p4_found": """
        SELECT DISTINCT chunk_id FROM recipe_chunks JOIN chunk_profiles USING (profile_id)
        WHERE len(list_filter(regexp_split_to_array(chunk_text, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{3000}]+'), lambda x: x <> '')) > chunk_size""",
    "p7_found": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
             i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
             p AS (SELECT item_id, least(len(w), 12) AS n, unnest(range(0, len(w) - least(len(w), 12) + 1)) AS k, w FROM i WHERE len(w) > 0),
             iw AS (SELECT DISTINCT item_id, array_to_string(w[k + 1 : k + n], ' ') AS words FROM p),
             q AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS k, w FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
             dw AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + n], ' ') AS words FROM q)
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (words)""",
}
