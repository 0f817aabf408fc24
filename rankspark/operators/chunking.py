"""Texts cut into chunks: by field, by sentences, by a word budget, and where meaning changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import text as X


def field_chunks(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One chunk per non-empty field: (key, field_name, chunk_index, chunk_text, text_hash, token_count)."""
    parts = F.array(*[F.struct(F.lit(f).alias("field_name"), X.squeeze(F.col(f)).alias("chunk_text")) for f in fields])
    return _described(rows.select(F.col(key).alias("key"), F.inline(parts)))


def full_chunks(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One chunk of all chosen fields together; rows without text have none."""
    return _described(rows.select(F.col(key).alias("key"), F.lit("").alias("field_name"), X.searchable_text(*[F.col(f) for f in fields]).alias("chunk_text")))


def _described(chunks: DataFrame) -> DataFrame:
    kept = chunks.filter("chunk_text <> ''").withColumn("chunk_index", F.lit(0))
    return kept.withColumns({"text_hash": X.content_hash(F.col("chunk_text")), "token_count": X.word_count(F.col("chunk_text"))})


def sentence_groups(text: Column, n: int) -> Column:
    """Groups of n consecutive sentences, the rest kept, as an array of strings; none for null and empty texts."""
    cut = X.sentences(text)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(cut) / n).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice(cut, i * n + 1, n), " "))
    return F.when(F.size(cut) > 0, groups).otherwise(F.array().cast("array<string>"))


def word_budget(text: Column, budget: int) -> Column:
    """Whole words packed greedily up to `budget` cost, a word costing one token per four letters; a dear word stands alone."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("cost"))

    def add(s: Column, w: Column) -> Column:
        cost = F.ceil(F.length(w) / 4).cast("int")
        fits = (s.open == "") | (s.cost + cost <= budget)
        joined = F.when(s.open == "", w).otherwise(F.concat(s.open, F.lit(" "), w))
        return F.when(fits, F.struct(s.done.alias("done"), joined.alias("open"), (s.cost + cost).alias("cost"))).otherwise(
            F.struct(F.concat(s.done, F.array(s.open)).alias("done"), w.alias("open"), cost.alias("cost"))
        )

    return F.aggregate(words, start, add, lambda s: F.when(s.open == "", s.done).otherwise(F.concat(s.done, F.array(s.open))))


def assemble(rows: DataFrame, key: str, title: str, summary: Column, ingredients: Column, steps: Column) -> DataFrame:
    """(key, kind, position, content): a summary and an ingredients chunk at 0, steps (an array) from 1, each under the title."""
    parts = F.concat(
        F.array(F.struct(F.lit("summary").alias("kind"), F.lit(0).alias("position"), summary.alias("body"))),
        F.array(F.struct(F.lit("ingredients").alias("kind"), F.lit(0).alias("position"), F.concat(F.lit("Ingredients: "), ingredients).alias("body"))),
        F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda s, i: F.struct(F.lit("step").alias("kind"), (i + 1).alias("position"), s.alias("body"))),
    )
    cut = rows.select(F.col(key).alias("key"), F.col(title).alias("title"), F.inline(parts)).filter("body IS NOT NULL AND body <> ''")
    return cut.select("key", "kind", "position", F.concat_ws("\n", "title", "body").alias("content"))


def sentence_vectors(sentences: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: a stand-in where no encoder is at hand."""
    import re
    import zlib

    out = np.zeros((len(sentences), size))
    for i, s in enumerate(sentences):
        for w in re.findall("[a-z0-9]+", s.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % size] += 1 if h & 65536 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def semantic_pieces(sentences: list[str], vectors: np.ndarray, least: int = 80, most: int = 400, percentile: float = 25) -> list[str]:
    """Sentences joined where they go together: breaks below the percentile of neighbour similarity; short pieces join the
    closer neighbour (ties: the one before); long ones are cut at their weakest link."""
    if not sentences:
        return []
    near = (vectors[:-1] * vectors[1:]).sum(1)
    groups = [[0]]
    bar = np.percentile(near, percentile) if len(near) else 0.0
    for i in range(1, len(sentences)):
        if near[i - 1] < bar:
            groups.append([i])
        else:
            groups[-1].append(i)
    size = lambda g: len(" ".join(sentences[i] for i in g))
    k = 0
    while k < len(groups) and len(groups) > 1:
        if size(groups[k]) >= least:
            k += 1
            continue
        before = near[groups[k][0] - 1] if k else -np.inf
        after = near[groups[k][-1]] if k + 1 < len(groups) else -np.inf
        j = k - 1 if before >= after else k
        groups[j : j + 2] = [groups[j] + groups[j + 1]]
        k = max(j, 0)

    def cut(g: list[int]) -> list[list[int]]:
        if len(g) < 2 or size(g) <= most:
            return [g]
        weakest = min(range(len(g) - 1), key=lambda i: (near[g[i]], i))
        return cut(g[: weakest + 1]) + cut(g[weakest + 1 :])

    return [" ".join(sentences[i] for i in g) for whole in groups for g in cut(whole)]


def semantic_chunks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position from 1, content) by semantic_pieces(); each text is one row, so nothing is grouped or shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i, c) for k, s in zip(batch["key"], batch["sentences"]) for i, c in enumerate(semantic_pieces(list(s), sentence_vectors(list(s))), 1)]
            yield pd.DataFrame(out, columns=["key", "position", "content"])

    cut = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), X.sentences(F.col(text)).alias("sentences"))
    return cut.mapInPandas(run, "key bigint, position int, content string")
