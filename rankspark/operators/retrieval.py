"""Sparse, dense, fused and reranked retrieval for whole batches of queries: one lazy plan for all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankspark.functions.text import tokens

#: Query vectors held against all rows at once; more queries take more passes.
QUERY_BLOCK = 4096
#: Queries of a block of sparse(): so many columns has the matrix of its terms.
QUERIES = 512
#: Most scores that a task holds at once.
SCORES = 4_000_000


def where(category: list | None = None, ranges: dict[str, tuple] | None = None, category_column: str = "lang") -> Column:
    """A filter: membership (an empty list is no filter) and inclusive bounds, a null attribute never matching a bound."""
    out = F.lit(True)
    if category:
        out &= F.col(category_column).isin(list(category))
    for name, (low, high) in (ranges or {}).items():
        if low is not None:
            out &= F.col(name) >= low
        if high is not None:
            out &= F.col(name) <= high
    return out


def check_filters(filters: dict, known: set[str]) -> None:
    """Raise ValueError for filters that aren't known."""
    if unknown := set(filters) - known:
        raise ValueError(f"unknown filters: {sorted(unknown)}")


def check_request(text: str, k: int, filters: dict, known: set[str]) -> None:
    """Raise ValueError for a query of no or over 500 characters, k outside 1 to 50, or an unknown filter."""
    if not 1 <= len(text) <= 500:
        raise ValueError("the query must have 1 to 500 characters")
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    check_filters(filters, known)


def top_k(hits: DataFrame, group: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered in rank; pruned before and after the shuffle."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, term): distinct terms of each query; blank queries have none."""
    return queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct()


def bm25_weights(docs: DataFrame, terms: DataFrame, key: str, text: str, scope: str | None = None, keep: Column | None = None, k1: float = 1.2, b: float = 0.75, few: bool = False) -> DataFrame:
    """(key, scope, term, w): what each term of any query adds to the score of a document that has it; cases as in bm25_scores().

    few: the terms fit in memory and go to all tasks, so that a document's terms stay where it is.
    """
    sent = F.broadcast if few else lambda rows: rows
    own = docs.select(F.col(key).alias("key"), (F.col(scope) if scope else F.lit("")).alias("scope"), tokens(F.col(text)).alias("words"), (F.lit(True) if keep is None else keep).alias("keep"))
    own = own.withColumn("dl", F.size("words"))
    stats = own.groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = terms.select("term").distinct()
    postings = own.select("key", "scope", "dl", "keep", F.explode("words").alias("term")).join(sent(wanted), "term", "left_semi").groupBy("key", "scope", "dl", "keep", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("scope", "term").agg(F.count("*").alias("df"))
    weights = df.join(stats, "scope").select("scope", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.filter("keep").join(sent(weights), ["scope", "term"]).select("key", "scope", "term", weight.alias("w"))


def bm25_scores(docs: DataFrame, terms: DataFrame, key: str, text: str, scope: str | None = None, keep: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score): every document that has a term of the query.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Counts are those of the whole scope (all documents by default); keep only
    says which documents may be hits. Scores are rounded to 6 places, so that equal documents tie.
    """
    scored = bm25_weights(docs, terms, key, text, scope, keep, k1, b).select("key", "term", "w")
    return scored.join(terms, "term").groupBy("query_id", "key").agg(F.round(F.sum("w"), 6).alias("score"))


def sparse(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int = 10, **how) -> DataFrame:
    """(query_id, rank, key, score) of the k best documents by BM25; equal scores by key.

    As the k best of bm25_scores(), over all hits, but these never leave their task: documents are spread by key, the terms
    of the queries (which must fit in memory) go to all of them, and a document's scores for a block of QUERIES queries are
    one row of a matrix product, of which only the best k a query leave the task.
    """
    asked = query_terms(queries, query_key, query_text).toArrow()
    ids, terms = asked.column("query_id").combine_chunks().dictionary_encode("encode"), asked.column("term").combine_chunks().dictionary_encode()
    names, query, term = ids.dictionary, ids.indices.to_numpy(), terms.indices.to_numpy()
    blocks = []  # of each: queries, their terms, and the places of terms in queries
    for at in range(0, len(names), QUERIES):
        own = (query >= at) & (query < at + QUERIES)
        used, place = np.unique(term[own], return_inverse=True)
        blocks.append((names.slice(at, QUERIES), used, place, query[own] - at))
    spark, n_terms = docs.sparkSession, len(terms.dictionary)
    numbered = spark.createDataFrame(pa.table({"term": terms.dictionary.cast("string"), "number": pa.array(np.arange(n_terms), "int32")}), "term string, number int")
    weights = bm25_weights(docs.repartition(key), numbered, key, text, **how, few=True).join(F.broadcast(numbered), "term")
    own = weights.groupBy("key").agg(F.collect_list("number").alias("terms"), F.collect_list("w").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by([("key", "ascending")])  # so that the first of equal scores is the one of the least key
            keys, lists = batch.column("key"), batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            number, w = lists.flatten().to_numpy(zero_copy_only=False), batch.column("w").flatten().to_numpy(zero_copy_only=False)
            for asking, used, place, of in blocks:
                matrix = np.zeros((len(used), len(asking)))
                matrix[place, of] = 1
                column = np.full(n_terms, -1)
                column[used] = np.arange(len(used))
                step = max(1, SCORES // max(matrix.shape))
                for first in range(0, batch.num_rows, step):  # so many documents at once that their scores stay within a bound
                    part = slice(*np.searchsorted(row, (first, first + step)))
                    have = column[number[part]] >= 0
                    rows = np.zeros((min(step, batch.num_rows - first), len(used)))
                    np.add.at(rows, (row[part][have] - first, column[number[part]][have]), w[part][have])
                    sums = (rows @ matrix).T
                    score = np.where(sums > 0, np.round(sums, 6), -1)  # a hit's sum is above 0, if only by less than the rounding
                    if score.shape[1] > k:
                        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                        q, d = np.nonzero((score >= least[:, None]) & (score >= 0))  # ties of the k-th score are kept and decided below
                    else:
                        q, d = np.nonzero(score >= 0)
                    value = score[q, d]
                    order = np.lexsort((d, -value, q))
                    q, d, value = q[order], d[order], value[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < k
                    yield pa.RecordBatch.from_arrays([asking.take(pa.array(q[best])), keys.take(pa.array(first + d[best])), pa.array(value[best])], names=["query_id", "key", "score"])

    kinds = queries.schema[query_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    hits = own.mapInArrow(run, f"query_id {kinds[0]}, key {kinds[1]}, score double")
    return top_k(hits, "query_id", [F.desc("score"), F.asc("key")], k)


def with_zero(hits: DataFrame, docs: DataFrame, queries: DataFrame, key: str, query_key: str, k: int) -> DataFrame:
    """hits of sparse(), filled up to k with documents of score 0 by key, for queries that match fewer; hits are read once."""
    first = [r[0] for r in docs.select(key).distinct().orderBy(key).limit(2 * k).collect()]
    own = hits.filter("score > 0").groupBy("query_id").agg(F.collect_list(F.struct("key", "score")).alias("own"))
    asked = queries.select(F.col(query_key).alias("query_id")).distinct().join(own, "query_id", "left")
    kind = f"array<struct<key:{docs.schema[key].dataType.simpleString()},score:double>>"
    zero = F.array(*[F.struct(F.lit(x).alias("key"), F.lit(0.0).alias("score")) for x in first]).cast(kind)
    own, every = F.coalesce("own", F.array().cast(kind)), F.concat("own", F.filter("zero", lambda x: ~F.array_contains("own.key", x["key"])))
    found = asked.select("query_id", own.alias("own"), zero.alias("zero")).select("query_id", F.explode(every).alias("x")).select("query_id", "x.key", "x.score")
    return top_k(found, "query_id", [F.desc("score"), F.asc("key")], k)


def collapse(hits: DataFrame, chunks: DataFrame, chunk_key: str, item_key: str, k: int, overfetch: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The k best items of each query (or group of the columns `by` of hits) by their best chunk, over all hits.

    With overfetch only the overfetch * k best chunks of a group are looked at, so that items may be missing where one
    item has many chunks.
    """
    by = by or ["query_id"]
    pool = hits if overfetch is None else top_k(hits, by, [F.desc("score"), F.asc("key")], max(k * overfetch, k)).drop("rank")
    items = pool.join(chunks.select(F.col(chunk_key).alias("key"), F.col(item_key).alias("item")).distinct(), "key").groupBy(*by, "item").agg(F.max("score").alias("score"))
    return top_k(items, by, [F.desc("score"), F.asc("item")], k)


def bm25_items(docs: DataFrame, terms: DataFrame, key: str, text: str, item: str, scope: str, k: int) -> DataFrame:
    """(query_id, scope, item, score, rank): in each scope, with its own statistics, the k best items by their best document.

    As collapse() of bm25_scores(), over all hits, but these never leave their task: documents are spread by key, the terms
    of the queries (which must fit in memory) go to all of them, and a task keeps its k best items of each query and scope.
    An item among the k best of all is among those of the task that has its best document.
    """
    parts = 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    own = docs.select(F.struct(F.col(item).alias("item"), F.col(key).alias("doc")).alias("unit"), scope, text)
    weights = bm25_weights(own, terms, "unit", text, scope).select("scope", "key.item", "key.doc", "term", "w", F.pmod(F.xxhash64("scope", "key.doc"), F.lit(parts)).alias("part"))
    hits = weights.repartition(parts, "part").join(F.broadcast(terms), "term").groupBy("query_id", "scope", "part", "item", "doc").agg(F.round(F.sum("w"), 6).alias("score"))
    order = [F.desc("score"), F.asc("item")]
    local = top_k(hits.groupBy("query_id", "scope", "part", "item").agg(F.max("score").alias("score")), ["query_id", "scope", "part"], order, k)
    return top_k(local.groupBy("query_id", "scope", "item").agg(F.max("score").alias("score")), ["query_id", "scope"], order, k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def dense(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, cosine: bool = True, keep: Column | None = None) -> DataFrame:
    """(query_id, rank, key, score): exact nearest rows by cosine (or inner product) for each row of queries.

    queries has the same key and vector columns and is read in blocks of QUERY_BLOCK; each block is one matrix product
    per Arrow batch, of which only the best k a query leave the task. Rows with a null vector are no hits.
    """
    own = rows.filter(F.col(vector).isNotNull() & (F.lit(True) if keep is None else keep)).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"))

    def against(ids: np.ndarray, matrix: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                found, keys = (_unit(found) if cosine else found), batch.column("key").to_numpy(zero_copy_only=False)
                step = max(1, SCORES // len(keys))
                for at in range(0, len(ids), step):  # so many queries at once that their scores stay within a bound
                    score = np.round(matrix[at : at + step] @ found.T, 6)
                    if len(keys) > k:
                        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                        query, row = np.nonzero(score >= least[:, None])  # ties of the k-th score are kept and decided below
                    else:
                        query, row = (x.ravel() for x in np.indices(score.shape))
                    value = score[query, row]
                    order = np.lexsort((keys[row], -value, query))
                    query, row, value = query[order], row[order], value[order]
                    place = np.arange(len(query)) - np.searchsorted(query, query)
                    best = place < k
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + step][query[best]]), pa.array(keys[row[best]]), pa.array(value[best])], names=["query_id", "key", "score"])

        return own.mapInArrow(run, "query_id bigint, key bigint, score double")

    parts, ids, vectors = [], [], []

    def flush() -> None:
        if ids:
            matrix = np.array(vectors, float)
            parts.append(against(np.array(ids, np.int64), _unit(matrix) if cosine else matrix))
            ids.clear(), vectors.clear()

    for i, v in queries.filter(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        ids.append(i), vectors.append(v)
        if len(ids) == QUERY_BLOCK:
            flush()
    flush()
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id bigint, key bigint, score double, rank int")
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    return top_k(hits, "query_id", [F.desc("score"), F.asc("key")], k)


def ivf_index(rows: DataFrame, key: str, vector: str, clusters: int = 32, sample: int = 20_000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(rows with cluster, centroids): k-means fitted on at most `sample` rows (least hash of the key first), every row indexed."""
    fitted = np.array([r[0] for r in rows.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()], float)
    points, rng = _unit(fitted), np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(clusters, len(points)), replace=False)]
    for _ in range(12):
        nearest = (points @ centroids.T).argmax(1)
        centroids = _unit(np.array([points[nearest == c].mean(0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))]))

    @F.pandas_udf("int")
    def cluster_of(v: pd.Series) -> pd.Series:
        return pd.Series((np.array(v.tolist(), float) @ centroids.T).argmax(1) if len(v) else [], dtype="int32")

    return rows.filter(F.col(vector).isNotNull()).withColumn("cluster", cluster_of(F.col(vector).cast("array<double>"))), centroids


def ivf_search(indexed: DataFrame, centroids: np.ndarray, queries: DataFrame, key: str, vector: str, k: int = 10, probe: float = 0.7) -> DataFrame:
    """As dense(), but each query sees only the nearest ceil(probe * clusters) clusters; probe 1 is exact.

    Queries are grouped by probed cluster and joined on it, so a row meets only the queries that probe its cluster.
    """
    width = max(1, int(np.ceil(probe * len(centroids))))

    @F.pandas_udf("array<int>")
    def probes(v: pd.Series) -> pd.Series:
        order = np.argsort(-(np.array(v.tolist(), float) @ centroids.T), axis=1)[:, :width]
        return pd.Series([[int(c) for c in row] for row in order])

    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).filter("q IS NOT NULL")
    asked = asked.select("query_id", "q", F.explode(probes("q")).alias("cluster"))
    own = indexed.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), "cluster")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.round((_unit(np.array(a.tolist(), float)) * _unit(np.array(b.tolist(), float))).sum(1), 6))

    hits = own.join(asked, "cluster").select("query_id", "key", cosine("q", "v").alias("score"))
    return top_k(hits, "query_id", [F.desc("score"), F.asc("key")], k)


def rrf(rankings: list[DataFrame], rrf_k: int = 60) -> DataFrame:
    """(query_id, key, score): reciprocal rank fusion of rankings(query_id, key, rank) by one union and one aggregation."""
    every = rankings[0].select("query_id", "key", "rank")
    for other in rankings[1:]:
        every = every.unionByName(other.select("query_id", "key", "rank"))
    return every.groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"))


def rrf_joined(first: DataFrame, second: DataFrame, rrf_k: int = 60) -> DataFrame:
    """(query_id, key, sparse_rank, dense_rank, score): fusion of two rankings by a full outer join, with where each hit came from."""
    a = first.select("query_id", "key", F.col("rank").alias("sparse_rank"))
    b = second.select("query_id", "key", F.col("rank").alias("dense_rank"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    return a.join(b, ["query_id", "key"], "full").withColumn("score", F.round(part("sparse_rank") + part("dense_rank"), 9))


PROVENANCE_ORDER = [F.desc, F.asc_nulls_last, F.asc_nulls_last]


def fused(first: DataFrame, second: DataFrame, cut: int = 50, rrf_k: int = 60) -> DataFrame:
    """The first `cut` of rrf_joined(); ties as first seen: by sparse, then by dense rank."""
    return top_k(rrf_joined(first, second, rrf_k), "query_id", [F.desc("score"), F.asc_nulls_last("sparse_rank"), F.asc_nulls_last("dense_rank"), F.asc("key")], cut)


Scorer = Callable[[list[str], list[str]], list[float]]


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has: a stand-in where no cross-encoder is at hand."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, tokens(text))) / F.size(asked), 6)).otherwise(0.0)


def rerank(candidates: DataFrame, scorer: Scorer | None = None, k: int = 10) -> DataFrame:
    """(query_id, key, rank, rerank_score): candidates(query_id, key, rank, query_text, content) by a scorer; ties by prior rank.

    scorer: a model that scores batches of pairs of texts; None is lexical_score(), which needs no Python.
    """
    rows = candidates.select("query_id", "key", F.col("rank").cast("int").alias("prior"), F.coalesce("query_text", F.lit("")).alias("query_text"), F.coalesce("content", F.lit("")).alias("content"))
    if scorer is None:
        scored = rows.select("query_id", "key", "prior", lexical_score(F.col("query_text"), F.col("content")).alias("rerank_score"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"query_id": batch["query_id"], "key": batch["key"], "prior": batch["prior"], "rerank_score": scorer(batch["query_text"].tolist(), batch["content"].tolist())})

        scored = rows.mapInPandas(run, "query_id bigint, key bigint, prior int, rerank_score double")
    return top_k(scored, "query_id", [F.desc("rerank_score"), F.asc("prior"), F.asc("key")], k)
