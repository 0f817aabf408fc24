"""The search surface: validated requests, encoders, and sparse, dense and hybrid search of a loaded strategy at chunk or item level."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.operators import retrieval as R
from rankspark.operators.chunking import sentence_vectors

#: Texts in, one vector a row out.
Encoder = Callable[[list[str]], np.ndarray]
QUERY_PREFIX, DOCUMENT_PREFIX = "search_query: ", "search_document: "
#: Names of the numeric attributes that a request may bound, each as min_<name> and max_<name>.
BOUNDS = ("rating", "rating_count", "review_count", "prep_minutes", "cook_minutes", "total_minutes", "servings", "token_count", "n_chars", "chunk_index", "position")
#: The smaller set of filters of the command line.
COMMAND_FILTERS = ("category", "kind", "max_total_minutes", "min_rating", "max_token_count", "min_n_chars")


def hashed_encoder(texts: list[str]) -> np.ndarray:
    """Unit vectors of hashed words: a stand-in where no model is at hand. Prefixes don't count."""
    return sentence_vectors([t.removeprefix(QUERY_PREFIX).removeprefix(DOCUMENT_PREFIX) for t in texts])


def encode_with_retries(texts: list[str], encoder: Encoder, attempts: int = 4, pause: float = 1.0) -> np.ndarray:
    """Unit vectors of texts; a failing batch is tried again after pauses that double, then in halves; a single text that fails is an error."""
    for attempt in range(attempts):
        try:
            found = np.asarray(encoder(texts), float)
            if found.ndim != 2 or len(found) != len(texts) or not np.isfinite(found).all():
                raise ValueError(f"expected {len(texts)} finite vectors, got shape {found.shape}")
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            return found / np.where(norm == 0, 1, norm)
        except Exception:
            if attempt == attempts - 1 and len(texts) == 1:
                raise
            if attempt < attempts - 1:
                time.sleep(pause * 2**attempt)
    half = len(texts) // 2
    return np.concatenate([encode_with_retries(part, encoder, attempts, pause) for part in (texts[:half], texts[half:])])


def embed(rows: DataFrame, key: str, text: str, encoder: Encoder = hashed_encoder, prefix: str = DOCUMENT_PREFIX, batch: int = 256) -> DataFrame:
    """(key, vector): prefix and text through the encoder in batches; null and blank texts have no vector and no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.iloc[at : at + batch]
                yield pd.DataFrame({"key": part["key"], "vector": list(encode_with_retries((prefix + part["text"]).tolist(), encoder))})

    wanted = rows.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter(F.trim("text") != "")
    return wanted.mapInPandas(run, "key bigint, vector array<double>")


class Engine:
    """Search of chunk tables by strategy.

    strategies: name to a DataFrame with chunk_id, item_id, content and whatever columns filters name; a None says that
    the strategy is registered but not loaded. Results are lazy: (query_id, rank, chunk_id, item_id, kind, position,
    content, score) at chunk level, (query_id, rank, item_id, score, title, image, content) at item level; columns that the
    strategy lacks are null.
    """

    def __init__(self, strategies: dict[str, DataFrame | None], encoder: Encoder = hashed_encoder, scorer: R.Scorer | None = None, pool: int = 50):
        self.strategies, self.encoder, self.scorer, self.pool = strategies, encoder, scorer, pool

    def loaded(self, strategy: str) -> DataFrame:
        """The chunks of a strategy; unknown and not loaded ones are errors that say what is loaded."""
        names = ", ".join(sorted(n for n, df in self.strategies.items() if df is not None)) or "none"
        if strategy not in self.strategies:
            raise ValueError(f"unknown strategy {strategy!r}; loaded: {names}")
        if (chunks := self.strategies[strategy]) is None:
            raise ValueError(f"strategy {strategy!r} is registered but not loaded; loaded: {names}")
        return chunks

    def _keep(self, chunks: DataFrame, filters: dict, allowed: set[str], kinds: set[str] | None):
        known = allowed & ({"category", "kind"} | {f"{side}_{b}" for side in ("min", "max") for b in BOUNDS})
        R.check_filters(filters, known)
        if kinds is not None and (bad := set(filters.get("kind") or []) - kinds):
            raise ValueError(f"unknown kinds: {sorted(bad)}")
        keep = F.lit(True)
        for name in ("category", "kind"):
            if filters.get(name):
                keep &= F.col(name).isin(list(filters[name]))
        return keep & R.where(ranges={b: (filters.get(f"min_{b}"), filters.get(f"max_{b}")) for b in BOUNDS if b in chunks.columns})

    def search(self, strategy: str, queries: DataFrame, mode: str = "hybrid", k: int = 10, filters: dict | None = None, level: str = "chunk", kinds: set[str] | None = None) -> DataFrame:
        """The k best of every row of queries(query_id, text); blank queries have none. mode: sparse, dense, fusion or hybrid (reranked)."""
        if not 1 <= k <= 50 or mode not in ("sparse", "dense", "fusion", "hybrid") or level not in ("chunk", "item"):
            raise ValueError("k must be 1 to 50, mode sparse, dense, fusion or hybrid, level chunk or item")
        chunks = self.loaded(strategy)
        filters = filters or {}
        allowed = {"category", "kind"} & set(chunks.columns) | {f"{side}_{c}" for side in ("min", "max") for c in chunks.columns}
        keep = F.coalesce(self._keep(chunks, filters, allowed, kinds), F.lit(False))
        asked = queries.select("query_id", "text").filter(F.trim("text") != "")
        deep = k if mode in ("sparse", "dense") and level == "chunk" else max(self.pool, 2 * k)
        lists = {}
        if mode != "dense":
            lists["sparse"] = R.bm25_scores(chunks, R.query_terms(asked, "query_id", "text"), "chunk_id", "content", keep=keep)
        if mode != "sparse":
            rows = embed(chunks.filter(keep), "chunk_id", "content", self.encoder).select(F.col("key").alias("id"), "vector")
            own = embed(asked, "query_id", "text", self.encoder, QUERY_PREFIX).select(F.col("key").alias("id"), "vector")
            lists["dense"] = R.dense(rows, own, "id", "vector", deep).select("query_id", "key", "score")
        if level == "item":
            items = chunks.select("chunk_id", "item_id")
            found = {n: R.collapse(hits, items, "chunk_id", "item_id", deep).select("query_id", F.col("item").alias("key"), "score", "rank") for n, hits in lists.items()}
        else:
            found = {n: R.top_k(hits, "query_id", [F.desc("score"), F.asc("key")], deep) for n, hits in lists.items()}
        if len(found) == 1:
            best = next(iter(found.values())).filter(F.col("rank") <= k)
        else:
            pool = R.fused(found["sparse"].filter(F.col("rank") <= self.pool), found["dense"].filter(F.col("rank") <= self.pool), self.pool)
            best = pool.filter(F.col("rank") <= k)
            if mode == "hybrid":
                texts = chunks.groupBy(F.col("item_id" if level == "item" else "chunk_id").alias("key")).agg(F.max("content").alias("content"))
                asked_pool = pool.select("query_id", "key", "rank").join(asked.withColumnRenamed("text", "query_text"), "query_id").join(texts, "key")
                best = R.rerank(asked_pool, self.scorer, k).withColumnRenamed("rerank_score", "score")
        return self._shown(best, chunks, level)

    def _shown(self, best: DataFrame, chunks: DataFrame, level: str) -> DataFrame:
        have = lambda name: F.col(name) if name in chunks.columns else F.lit(None).cast("string")
        best = best.select("query_id", F.col("rank").cast("int").alias("rank"), "key", "score")
        if level == "item":
            about = chunks.groupBy(F.col("item_id").alias("key")).agg(F.max(have("title")).alias("title"), F.max(have("image")).alias("image"), F.max("content").alias("content"))
            return best.join(about, "key").select("query_id", "rank", F.col("key").alias("item_id"), "score", "title", "image", "content")
        about = chunks.select(F.col("chunk_id").alias("key"), "item_id", have("kind").alias("kind"), have("position").cast("int").alias("position"), "content")
        return best.join(about, "key").select("query_id", "rank", F.col("key").alias("chunk_id"), "item_id", "kind", "position", "content", "score")


def lookup_in_order(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of the given keys in the order of the list (place, from 0), once for each time a key is listed. The list is the caller's own."""
    wanted = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], T.StructType([T.StructField("place", T.IntegerType()), T.StructField(key, rows.schema[key].dataType)]))
    return rows.join(F.broadcast(wanted), key).orderBy("place")
