"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators import retrieval as R
from rankspark.session import table


def _bench(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", "text")


def _named(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _named(R.sparse(table(spark, folder, "documents"), _bench(spark, folder), "doc_id", "text", "item_id", "text"))


def bm25_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    keep = R.where(["en", "EN"], {"n_chars": (200, 1000)})
    return _named(R.sparse(table(spark, folder, "documents"), _bench(spark, folder), "doc_id", "text", "item_id", "text", keep=F.coalesce(keep, F.lit(False))))


def bm25_strategy_isolation(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by doc_kind, hits in recipes only."""
    return _named(R.sparse(table(spark, folder, "documents"), _bench(spark, folder), "doc_id", "text", "item_id", "text", scope="doc_kind", keep=F.col("doc_kind") == "recipe"))


def bm25_include_zero(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    hits = R.sparse(docs, _bench(spark, folder), "doc_id", "text", "item_id", "text")
    return _named(R.with_zero(hits, docs, _bench(spark, folder), "doc_id", "item_id", 10))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recipe_chunks").filter("profile_id = 3").select("chunk_id", "recipe_idx", "chunk_text").distinct()


def bm25_recipe_max_collapse(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    hits = R.bm25_scores(chunks, R.query_terms(_bench(spark, folder), "item_id", "text"), "chunk_id", "chunk_text")
    found = R.collapse(hits, chunks, "chunk_id", "recipe_idx", 10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("item").alias("recipe_idx"), "score")


def bm25_recipe_max_collapse_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """As bm25_recipe_max_collapse, which is profile 3 alone, for each profile with its own statistics: its ten best recipes of each query."""
    chunks = table(spark, folder, "recipe_chunks").select("profile_id", "chunk_id", "recipe_idx", "chunk_text").distinct()
    found = R.bm25_items(chunks, R.query_terms(_bench(spark, folder), "item_id", "text"), "chunk_id", "chunk_text", "recipe_idx", "profile_id", 10)
    return found.select("query_id", F.col("scope").alias("profile_id"), F.col("rank").cast("int").alias("rank"), F.col("item").alias("recipe_idx"), "score")


def bm25_df_stats(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "documents").select("doc_kind", F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("term"))
    return terms.groupBy("doc_kind", "term").agg(F.count("*").alias("df"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings")
    return rows, rows.filter("vec_id % 20 = 0")


def dense_topk_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _named(R.dense(*_vectors(spark, folder), "vec_id", "embedding"), "vec_id")


def dense_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _named(R.dense(*_vectors(spark, folder), "vec_id", "embedding", keep=F.col("label").isin(1, 2, 3)), "vec_id")


def dense_inner_product(spark: SparkSession, folder: str) -> DataFrame:
    return _named(R.dense(*_vectors(spark, folder), "vec_id", "embedding", cosine=False), "vec_id")


def ivf_probe_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows, queries = _vectors(spark, folder)
    indexed, centroids = R.ivf_index(rows, "vec_id", "embedding")
    return _named(R.ivf_search(indexed, centroids, queries, "vec_id", "embedding"), "vec_id")


def _ranking(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """One of the two rankings in candidate; a chunk's best rank where it has several."""
    rows = table(spark, folder, "candidate").filter(F.col(column).isNotNull())
    return rows.groupBy("query_id", F.col("chunk_id").alias("key")).agg(F.min(column).alias("rank"))


def rrf_union_agg(spark: SparkSession, folder: str) -> DataFrame:
    both = R.rrf([_ranking(spark, folder, "sparse_rank"), _ranking(spark, folder, "dense_rank")])
    return _named(R.top_k(both, "query_id", [F.desc("score"), F.asc("key")], 10), "chunk_id")


def rrf_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    both = R.rrf_joined(_ranking(spark, folder, "sparse_rank"), _ranking(spark, folder, "dense_rank"))
    return _named(R.top_k(both, "query_id", [F.desc("score"), F.asc("key")], 10), "chunk_id")


def rrf_provenance(spark: SparkSession, folder: str) -> DataFrame:
    found = R.fused(_ranking(spark, folder, "sparse_rank"), _ranking(spark, folder, "dense_rank"), 50)
    return found.select("query_id", "rank", F.col("key").alias("chunk_id"), "sparse_rank", "dense_rank", "score")


def rrf_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """Queries for which the two forms of fusion give the same first ten; all of them should."""
    a = rrf_union_agg(spark, folder).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("a"))
    b = rrf_full_outer(spark, folder).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("b"))
    return a.join(b, "query_id", "full").agg(F.count("*").alias("queries"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def hybrid_rerank_lexical(spark: SparkSession, folder: str) -> DataFrame:
    pool = R.fused(_ranking(spark, folder, "sparse_rank"), _ranking(spark, folder, "dense_rank"), 50)
    texts = table(spark, folder, "recipe_chunks").groupBy(F.col("chunk_id").alias("key")).agg(F.max("chunk_text").alias("content"))
    asked = table(spark, folder, "query_record").groupBy("query_id").agg(F.max("query_text").alias("query_text"))
    found = R.rerank(pool.select("query_id", "key", "rank").join(asked, "query_id").join(texts, "key"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("chunk_id"), "rerank_score")


def best_chunk_per_recipe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidate").filter("score IS NOT NULL AND NOT isnan(score) AND recipe_id IS NOT NULL")
    best = F.min(F.struct((-F.col("score")).alias("s"), "chunk_id"))
    return rows.groupBy("query_id", "recipe_id").agg(best.alias("b")).select("query_id", "recipe_id", F.col("b.chunk_id").alias("chunk_id"), (-F.col("b.s")).alias("score"))


NAMES = (
    "bm25_topk bm25_topk_filtered bm25_strategy_isolation bm25_include_zero bm25_recipe_max_collapse bm25_recipe_max_collapse_profiles bm25_df_stats dense_topk_cosine dense_topk_filtered dense_inner_product ivf_probe_topk "
    "rrf_union_agg rrf_full_outer rrf_provenance rrf_equivalence hybrid_rerank_lexical best_chunk_per_recipe"
).split()
QUERIES = {name: globals()[name] for name in NAMES}


def _bm25(docs: str, keep: str = "true") -> str:
    """docs: SQL giving key, scope, text and the columns of keep."""
    return f"""WITH d AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM ({docs})),
        s AS (SELECT scope, count(*) AS n, avg(coalesce(len(w), 0)) AS avgdl FROM d GROUP BY scope),
        q AS (SELECT DISTINCT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
        p AS (SELECT key, scope, dl, ok, term, count(*) AS tf FROM (SELECT key, scope, len(w) AS dl, coalesce({keep}, false) AS ok, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        f AS (SELECT scope, term, count(*) AS df FROM p GROUP BY ALL),
        hits AS (SELECT query_id, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
                 FROM p JOIN f USING (scope, term) JOIN s USING (scope) JOIN q USING (term) WHERE ok GROUP BY ALL)"""


_TOP = "SELECT query_id, CAST(rank AS INTEGER) AS rank, key AS {name}, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM {hits}) WHERE rank <= 10"
_DOCS = "SELECT doc_id AS key, '' AS scope, text, lang, n_chars, doc_kind FROM documents"
_DENSE = """WITH hits AS (SELECT q.vec_id AS query_id, v.vec_id AS key, round({f}(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {keep}) """
_RANKS = """WITH a AS (SELECT query_id, chunk_id AS key, min(sparse_rank) AS sparse_rank FROM candidate WHERE sparse_rank IS NOT NULL GROUP BY ALL),
    b AS (SELECT query_id, chunk_id AS key, min(dense_rank) AS dense_rank FROM candidate WHERE dense_rank IS NOT NULL GROUP BY ALL),
    hits AS (SELECT query_id, key, sparse_rank, dense_rank, round(coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 9) AS score FROM a FULL JOIN b USING (query_id, key)),
    pool AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, key AS chunk_id, sparse_rank, dense_rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sparse_rank NULLS LAST, dense_rank NULLS LAST, key) AS rank FROM hits) WHERE rank <= 50) """
ORACLES = {
    "bm25_topk": _bm25(_DOCS) + _TOP.format(name="doc_id", hits="hits"),
    "bm25_topk_filtered": _bm25(_DOCS, "lang IN ('en', 'EN') AND n_chars BETWEEN 200 AND 1000") + _TOP.format(name="doc_id", hits="hits"),
    "bm25_strategy_isolation": _bm25("SELECT doc_id AS key, doc_kind AS scope, text, doc_kind FROM documents", "doc_kind = 'recipe'") + _TOP.format(name="doc_id", hits="hits"),
    "bm25_include_zero": _bm25("SELECT doc_id AS key, '' AS scope, text FROM documents")
    + ", every AS (SELECT item_id AS query_id, doc_id AS key, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN hits ON query_id = item_id AND key = doc_id) "
    + _TOP.format(name="doc_id", hits="every"),
    "bm25_recipe_max_collapse": _bm25("SELECT DISTINCT chunk_id AS key, '' AS scope, chunk_text AS text FROM recipe_chunks WHERE profile_id = 3")
    + """, pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM hits) WHERE r <= 50),
        items AS (SELECT query_id, recipe_idx AS key, max(score) AS score FROM pool JOIN (SELECT DISTINCT chunk_id, recipe_idx FROM recipe_chunks WHERE profile_id = 3) ON key = chunk_id GROUP BY ALL) """
    + _TOP.format(name="recipe_idx", hits="items"),
    "bm25_df_stats": "SELECT doc_kind, term, count(*) AS df FROM (SELECT doc_kind, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) GROUP BY ALL",
    "dense_topk_cosine": _DENSE.format(f="list_cosine_similarity", keep="true") + _TOP.format(name="vec_id", hits="hits"),
    "dense_topk_filtered": _DENSE.format(f="list_cosine_similarity", keep="v.label IN (1, 2, 3)") + _TOP.format(name="vec_id", hits="hits"),
    "dense_inner_product": _DENSE.format(f="list_dot_product", keep="true") + _TOP.format(name="vec_id", hits="hits"),
    "rrf_union_agg": _RANKS + _TOP.format(name="chunk_id", hits="hits"),
    "rrf_full_outer": _RANKS + _TOP.format(name="chunk_id", hits="hits"),
    "rrf_provenance": _RANKS + "SELECT * FROM pool",
    "rrf_equivalence": "SELECT count(DISTINCT query_id) AS queries, count(DISTINCT query_id) AS same FROM candidate WHERE sparse_rank IS NOT NULL OR dense_rank IS NOT NULL",
    "hybrid_rerank_lexical": _RANKS
    + """, t AS (SELECT chunk_id, max(chunk_text) AS content FROM recipe_chunks GROUP BY 1), r AS (SELECT query_id, max(query_text) AS query_text FROM query_record GROUP BY 1),
        x AS (SELECT query_id, chunk_id, rank AS prior, list_distinct(regexp_extract_all(lower(coalesce(query_text, '')), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS c FROM pool JOIN r USING (query_id) JOIN t USING (chunk_id)),
        y AS (SELECT query_id, chunk_id, prior, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, c)) / len(q), 6) ELSE 0.0 END AS rerank_score FROM x)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, prior) AS rank FROM y) WHERE rank <= 10""",
    "best_chunk_per_recipe": "SELECT DISTINCT ON (query_id, recipe_id) query_id, recipe_id, chunk_id, score FROM candidate WHERE score IS NOT NULL AND NOT isnan(score) AND recipe_id IS NOT NULL ORDER BY query_id, recipe_id, score DESC, chunk_id",
}
