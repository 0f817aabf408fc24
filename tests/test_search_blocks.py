"""Sparse search in blocks: no pair of a query and a document leaves its task but the best, and hits are read once."""

import re

from rankspark.operators import retrieval


def test_hits_are_read_once_and_zero_scores_go_by_key(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = spark.range(1, 31).selectExpr("id")
    queries = spark.createDataFrame([(1,), (2,), (3,), (None,)], "q long")
    rows = [(1, 20, 1.0), (1, 29, 0.0), (1, 28, 0.0), (2, 1, 2.0), (2, 9, 2.5), (2, 7, 2.0)]  # 0.0 is a sum below the rounding
    hits = spark.createDataFrame(rows, "query_id long, key long, score double").mapInPandas(counted, "query_id long, key long, score double")
    got = {(r.query_id, r["rank"]): (r.key, r.score) for r in retrieval.with_zero(hits, docs, queries, "id", "q", 3).collect()}
    assert read.value == len(rows)
    zeros = {(q, k): (k, 0.0) for q in (3, None) for k in (1, 2, 3)}
    assert got == zeros | {(1, 1): (20, 1.0), (1, 2): (1, 0.0), (1, 3): (2, 0.0), (2, 1): (9, 2.5), (2, 2): (1, 2.0), (2, 3): (7, 2.0)}


def test_best_documents_of_many_queries(spark, monkeypatch):
    """More queries than a block has, many equal scores, rows cut small; text keys; a repeated document."""
    monkeypatch.setattr(retrieval, "QUERIES", 7, raising=False)
    monkeypatch.setattr(retrieval, "SCORES", 90)
    rows = [(f"d{i:03}", "soup " * (i % 3) + "red " * (i % 2) + f"w{i % 9} x{i % 5}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([*rows, rows[3], ("e", None, 0), ("f", " ", 1)], "id string, t string, part int")
    queries = spark.createDataFrame([(i, f"w{i} soup x{i % 6} nowhere") for i in range(20)] + [(30, "nowhere"), (31, None)], "q long, t string")
    for how in ({}, {"scope": "part", "keep": docs["part"] == 1}):
        got = retrieval.sparse(docs, queries, "id", "t", "q", "t", 4, **how)
        scores = retrieval.bm25_scores(docs, retrieval.query_terms(queries, "q", "t"), "id", "t", **how)
        expected = retrieval.top_k(scores, "query_id", [scores.score.desc(), scores.key.asc()], 4)
        as_set = lambda df: {(r.query_id, r["rank"], r.key, r.score) for r in df.collect()}
        assert as_set(got) == as_set(expected) and got.count() == 80
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, key#", got._jdf.queryExecution().toString())  # no exchange of all pairs
    assert retrieval.sparse(docs, queries.filter("q > 30"), "id", "t", "q", "t").count() == 0
    assert retrieval.with_zero(retrieval.sparse(docs.limit(0), queries, "id", "t", "q", "t"), docs.limit(0), queries, "id", "q", 3).count() == 0
