"""Evaluation queries over stored rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators import evaluation as E
from rankspark.session import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of each query; of records of one time, that of the longer text and list."""
    rows = table(spark, folder, "query_record")
    order = [F.desc("recorded_at"), F.desc_nulls_last("query_text"), F.desc(F.size("ranked_ids")), F.desc(F.array_join(F.col("ranked_ids").cast("array<string>"), ",")), F.desc_nulls_last("search_ms"), F.desc_nulls_last("encode_ms")]
    return E.latest(rows, ["query_id"], order)


def metrics_multi_relevant(spark: SparkSession, folder: str) -> DataFrame:
    a, r = F.col("ranked_ids"), F.col("relevant_recipe_ids")
    rows = _records(spark, folder).select("family", *[E.recall_at(a, r, k).alias(f"recall_{k}") for k in (1, 5, 10)], E.reciprocal_rank(a, r).alias("mrr"), E.ndcg_at(a, r, 10).alias("ndcg_10"))
    return rows.groupBy("family").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr", "ndcg_10")])


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    """The recipe rankings that candidate holds, first 20 different recipes each: config, query_id, recipe_id, rank."""
    score = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), -F.col(c))
    orders = F.array(*[F.struct(F.lit(n).alias("config"), o.cast("double").alias("o")) for n, o in (("sparse", F.col("sparse_rank")), ("dense", F.col("dense_rank")), ("fusion", score("rrf_score")), ("hybrid", score("rerank_score")))])
    rows = table(spark, folder, "candidate").filter("recipe_id IS NOT NULL").select("query_id", "recipe_id", F.inline(orders)).filter("o IS NOT NULL")
    return E.unique_depth(rows, ["config", "query_id"], "recipe_id", "o")


def dedupe_depth20(spark: SparkSession, folder: str) -> DataFrame:
    return _lists(spark, folder).select("config", "query_id", "recipe_id", F.col("rank").cast("int").alias("rank"))


def _qrels(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("query_id", F.explode("relevant_recipe_ids").alias("recipe_id"))


def _firsts(spark: SparkSession, folder: str) -> DataFrame:
    configs = F.explode(F.array(*[F.lit(c) for c in ("sparse", "dense", "fusion", "hybrid")])).alias("config")
    every = _records(spark, folder).select("query_id", "family", configs)
    return E.first_ranks(_lists(spark, folder), _qrels(spark, folder), every)


def metrics_first_rank(spark: SparkSession, folder: str) -> DataFrame:
    return E.metrics_table(_firsts(spark, folder), ["config", "family"])


def short_lists(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _lists(spark, folder).groupBy("config", "query_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("config").agg(F.count_if(F.col("n") < E.DEPTH).alias("short"), F.count("*").alias("lists"))


def latency_p50_p95(spark: SparkSession, folder: str) -> DataFrame:
    return E.latency(table(spark, folder, "query_record"), ["family"], "search_ms")


def latency_by_type_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Median event value by day and type, a column per type."""
    kinds = ["click", "view", "purchase", "signup", "error"]
    rows = table(spark, folder, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    medians = [F.round(F.percentile(F.when(F.col("event_type") == k, F.col("value")), F.lit(0.5)), 6).alias(k) for k in kinds]
    return rows.groupBy("day").agg(*medians, F.count("*").alias("events"))


def step_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = (F.floor(F.length("chunk_text") / 50) * 50).cast("bigint").alias("bin")
    return table(spark, folder, "recipe_chunks").groupBy("profile_id", bins).agg(F.count("*").alias("n"))


def step_length_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    p = F.percentile(F.length("chunk_text"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    rows = table(spark, folder, "recipe_chunks").groupBy("profile_id").agg(p.alias("p"), F.min(F.length("chunk_text")).alias("least"), F.max(F.length("chunk_text")).alias("most"))
    return rows.select("profile_id", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "least", "most")


def overlap_unit_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder).select(E.unit_bin(E.recall_at(F.col("ranked_ids"), F.col("relevant_recipe_ids"), 10)).alias("bin"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


def _pivoted(spark: SparkSession, folder: str) -> DataFrame:
    configs = ("sparse", "dense", "fusion", "hybrid")
    picked = [F.min(F.when(F.col("config") == c, F.col("rank"))).alias(c) for c in configs]
    return _firsts(spark, folder).groupBy("query_id", "family").agg(*picked)


def failure_buckets(spark: SparkSession, folder: str) -> DataFrame:
    ranks = _pivoted(spark, folder)
    return E.failure_buckets(ranks, "sparse", "dense").unionByName(E.failure_buckets(ranks, "fusion", "hybrid")).groupBy("bucket").agg(F.count("*").alias("n"))


def rerank_net(spark: SparkSession, folder: str) -> DataFrame:
    """Of queries that have a reranked list, whatever it holds: a right recipe that is not in it is a miss."""
    reranked = _lists(spark, folder).filter("config = 'hybrid'").select("query_id").distinct()
    return E.net_effect(_pivoted(spark, folder).join(reranked, "query_id", "left_semi"), "fusion", "hybrid")


def every_miss(spark: SparkSession, folder: str) -> DataFrame:
    """Queries that no configuration answers within 20."""
    return _pivoted(spark, folder).filter("sparse IS NULL AND dense IS NULL AND fusion IS NULL AND hybrid IS NULL").select("query_id", "family")


def misses_by_family(spark: SparkSession, folder: str) -> DataFrame:
    ranks = _pivoted(spark, folder)
    return ranks.groupBy("family").agg(*[F.count_if(F.coalesce(F.col(c), F.lit(E.MISS)) > 10).alias(f"{c}_misses") for c in ("sparse", "dense", "fusion", "hybrid")])


def best_rows_ties(spark: SparkSession, folder: str) -> DataFrame:
    means = E.metrics_table(_firsts(spark, folder), ["config", "family"]).withColumn("recall_10", F.round("recall_10", 2))
    return E.best_rows(means, ["family"], F.desc("recall_10")).select("family", "config", "recall_10")


def holm_adjust(spark: SparkSession, folder: str) -> DataFrame:
    """Recall shares of configuration and family as if they were p values, adjusted together."""
    tests = E.metrics_table(_firsts(spark, folder), ["config", "family"]).select("config", "family", (F.col("recall_10") / 100).alias("p"))
    return E.holm(tests).select("config", "family", F.round("p", 9).alias("p"), "p_holm")


def rank_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Stored gold ranks against those of the stored lists."""
    records = _records(spark, folder)
    again = E.rescore(records, "ranked_ids", _qrels(spark, folder))
    return E.rank_mismatches(records.select("query_id", "gold_rank"), again.select("query_id", F.col("rank").alias("gold_rank")), ["query_id"], "gold_rank")


def ranking_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """First and last records of queries that were recorded twice."""
    rows = table(spark, folder, "query_record")
    tie = [F.desc(F.size("ranked_ids")), F.desc(F.array_join(F.col("ranked_ids").cast("array<string>"), ","))]
    first = E.latest(rows, ["query_id"], [F.asc("recorded_at"), *tie]).select("query_id", F.col("ranked_ids").alias("a"))
    last = E.latest(rows, ["query_id"], [F.desc("recorded_at"), *tie]).select("query_id", F.col("ranked_ids").alias("b"))
    return E.ranking_overlap(first.join(last, "query_id"), "a", "b")


def rescore_qrels(spark: SparkSession, folder: str) -> DataFrame:
    """Stored lists under another answer key: the source recipe alone."""
    records = _records(spark, folder)
    found = E.rescore(records, "ranked_ids", records.select("query_id", F.col("source_recipe_idx").alias("recipe_id")))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"))


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Poisson bootstrap of the mean reciprocal rank by family."""
    rows = _records(spark, folder).select("family", "query_id", E.reciprocal_rank(F.col("ranked_ids"), F.col("relevant_recipe_ids")).alias("rr"))
    return E.poisson_bootstrap(rows, ["family"], "query_id", "rr")


def paired_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse against dense over a family's reciprocal ranks, from the histogram of differences (they take few values)."""
    rows = _pivoted(spark, folder)
    rr = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    counts = rows.groupBy("family", F.round(rr("sparse") - rr("dense"), 9).alias("d")).agg(F.count("*").alias("n")).orderBy("family", "d").collect()
    out = []
    for family in sorted({r.family for r in counts}):
        d, n = np.array([r.d for r in counts if r.family == family]), np.array([r.n for r in counts if r.family == family])
        out.append((family, *E.counted_bootstrap(d, n)))
    return spark.createDataFrame(out, "family string, difference double, low double, high double, p double")


NAMES = (
    "metrics_multi_relevant dedupe_depth20 metrics_first_rank short_lists latency_p50_p95 latency_by_type_pivot step_length_histogram step_length_percentiles overlap_unit_histogram failure_buckets "
    "rerank_net every_miss misses_by_family best_rows_ties holm_adjust rank_mismatch ranking_overlap rescore_qrels bootstrap_ci paired_bootstrap"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_REC = """rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recorded_at DESC, query_text DESC NULLS LAST, len(ranked_ids) DESC, array_to_string(ranked_ids, ',') DESC, search_ms DESC NULLS LAST, encode_ms DESC NULLS LAST) AS n FROM query_record) WHERE n = 1)"""
_LISTS = """o AS (SELECT query_id, recipe_id, unnest(['sparse', 'dense', 'fusion', 'hybrid']) AS config, unnest([CAST(sparse_rank AS DOUBLE), CAST(dense_rank AS DOUBLE), CASE WHEN NOT isnan(rrf_score) THEN -rrf_score END, CASE WHEN NOT isnan(rerank_score) THEN -rerank_score END]) AS o FROM candidate WHERE recipe_id IS NOT NULL),
    lists AS (SELECT config, query_id, recipe_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY o, recipe_id) AS rank FROM (SELECT config, query_id, recipe_id, min(o) AS o FROM o WHERE o IS NOT NULL GROUP BY ALL)) WHERE rank <= 20)"""
_FIRSTS = (
    f"WITH {_REC}, {_LISTS}"
    + """, qrels AS (SELECT DISTINCT query_id, unnest(relevant_recipe_ids) AS recipe_id FROM rec),
    firsts AS (SELECT e.query_id, e.family, e.config, f.rank FROM (SELECT query_id, family, unnest(['sparse', 'dense', 'fusion', 'hybrid']) AS config FROM rec) e
               LEFT JOIN (SELECT config, query_id, min(rank) AS rank FROM lists JOIN qrels USING (query_id, recipe_id) GROUP BY ALL) f USING (config, query_id)),
    pv AS (SELECT query_id, family, min(rank) FILTER (config = 'sparse') AS sparse, min(rank) FILTER (config = 'dense') AS dense, min(rank) FILTER (config = 'fusion') AS fusion, min(rank) FILTER (config = 'hybrid') AS hybrid FROM firsts GROUP BY ALL),
    means AS (SELECT config, family, count(*) AS queries, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0 END), 6) AS recall_20,
              round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1.0 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10 FROM firsts GROUP BY ALL) """
)
_RECALL = "CASE WHEN len(relevant_recipe_ids) > 0 THEN len(list_distinct(list_filter(ranked_ids[1:{k}], lambda x: list_contains(relevant_recipe_ids, x)))) / len(list_distinct(relevant_recipe_ids)) ELSE 0.0 END"
_FIRST_PLACE = "list_min(list_filter(list_transform(ranked_ids, lambda x, i: CASE WHEN list_contains({rel}, x) THEN i END), lambda p: p IS NOT NULL))"
_BUCKET = "SELECT CASE WHEN coalesce({a}, 21) <= 10 AND coalesce({b}, 21) > 10 THEN '{a}_win' WHEN coalesce({b}, 21) <= 10 AND coalesce({a}, 21) > 10 THEN '{b}_win' END AS bucket FROM pv"
ORACLES = {
    "metrics_multi_relevant": f"""WITH {_REC}, m AS (SELECT family, {_RECALL.format(k=1)} AS r1, {_RECALL.format(k=5)} AS r5, {_RECALL.format(k=10)} AS r10, coalesce(1.0 / {_FIRST_PLACE.format(rel='relevant_recipe_ids')}, 0) AS rr,
        CASE WHEN len(relevant_recipe_ids) > 0 THEN coalesce(list_sum(list_transform(ranked_ids[1:10], lambda x, i: CASE WHEN list_contains(relevant_recipe_ids, x) THEN 1.0 / log2(i + 1) ELSE 0.0 END)), 0)
          / list_sum(list_transform(range(1, least(10, len(relevant_recipe_ids)) + 1), lambda i: 1.0 / log2(i + 1))) ELSE 0.0 END AS g FROM rec)
        SELECT family, count(*) AS queries, round(avg(r1), 6) AS recall_1, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(rr), 6) AS mrr, round(avg(g), 6) AS ndcg_10 FROM m GROUP BY family""",
    "dedupe_depth20": f"WITH {_LISTS} SELECT * FROM lists",
    "metrics_first_rank": _FIRSTS + "SELECT * FROM means",
    "short_lists": f"WITH {_LISTS} SELECT config, count(*) FILTER (n < 20) AS short, count(*) AS lists FROM (SELECT config, query_id, count(*) AS n FROM lists GROUP BY ALL) GROUP BY config",
    "latency_p50_p95": """SELECT family, round(coalesce(quantile_cont(search_ms, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont(search_ms, 0.95), 0), 6) AS p95,
        coalesce(list_sort(list(search_ms) FILTER (search_ms IS NOT NULL))[least(count(search_ms), CAST(floor(count(search_ms) * 0.95) AS BIGINT) + 1)], 0) AS p95_at FROM query_record GROUP BY family""",
    "latency_by_type_pivot": "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"round(quantile_cont(value, 0.5) FILTER (event_type = '{k}'), 6) AS {k}" for k in ("click", "view", "purchase", "signup", "error")) + ", count(*) AS events FROM events GROUP BY 1",
    "step_length_histogram": "SELECT profile_id, CAST(length(chunk_text) // 50 * 50 AS BIGINT) AS bin, count(*) AS n FROM recipe_chunks GROUP BY ALL",
    "step_length_percentiles": "SELECT profile_id, quantile_cont(length(chunk_text), 0.1) AS p10, quantile_cont(length(chunk_text), 0.5) AS p50, quantile_cont(length(chunk_text), 0.9) AS p90, min(length(chunk_text))::INTEGER AS least, max(length(chunk_text))::INTEGER AS most FROM recipe_chunks GROUP BY profile_id",
    "overlap_unit_histogram": f"WITH {_REC} SELECT CAST(CASE WHEN v >= 1 THEN 10 ELSE floor(v / 0.1::DOUBLE) END AS INTEGER) AS bin, count(*) AS n FROM (SELECT {_RECALL.format(k=10)} AS v FROM rec) GROUP BY 1",
    "failure_buckets": _FIRSTS + "SELECT bucket, count(*) AS n FROM (" + _BUCKET.format(a="sparse", b="dense") + " UNION ALL " + _BUCKET.format(a="fusion", b="hybrid") + ") WHERE bucket IS NOT NULL GROUP BY bucket",
    "rerank_net": _FIRSTS
    + """SELECT count(*) FILTER (b > a) AS hurt, count(*) FILTER (b < a) AS help, count(*) FILTER (a = b) AS same, count(*) FILTER (a <= 5 AND b > 5) AS top5_left, count(*) FILTER (a > 5 AND b <= 5) AS top5_entered, count(*) FILTER (a > 5 AND b <= 5) - count(*) FILTER (a <= 5 AND b > 5) AS top5_net,
        quantile_cont(CASE WHEN b > a THEN b - a END, 0.5) AS median_drop, count(*) FILTER (a <= 20 AND b > 20) AS top20_left, count(*) FILTER (a > 20 AND b <= 20) AS top20_entered
        FROM (SELECT least(coalesce(fusion, 21), 21) AS a, least(coalesce(hybrid, 21), 21) AS b FROM pv WHERE query_id IN (SELECT query_id FROM candidate WHERE recipe_id IS NOT NULL AND rerank_score IS NOT NULL AND NOT isnan(rerank_score)))""",
    "every_miss": _FIRSTS + "SELECT query_id, family FROM pv WHERE sparse IS NULL AND dense IS NULL AND fusion IS NULL AND hybrid IS NULL",
    "misses_by_family": _FIRSTS + "SELECT family, " + ", ".join(f"count(*) FILTER (coalesce({c}, 21) > 10) AS {c}_misses" for c in ("sparse", "dense", "fusion", "hybrid")) + " FROM pv GROUP BY family",
    "best_rows_ties": _FIRSTS + "SELECT family, config, r AS recall_10 FROM (SELECT family, config, round(recall_10, 2) AS r, rank() OVER (PARTITION BY family ORDER BY round(recall_10, 2) DESC) AS n FROM means) WHERE n = 1",
    "holm_adjust": _FIRSTS
    + """, t AS (SELECT config, family, recall_10 / 100 AS p FROM means), a AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p) + 1)) AS raw, row_number() OVER (ORDER BY p) AS k FROM t)
        SELECT config, family, round(p, 9) AS p, round(max(raw) OVER (ORDER BY k), 9) AS p_holm FROM a""",
    "rank_mismatch": f"""WITH {_REC}, x AS (SELECT query_id, gold_rank, {_FIRST_PLACE.format(rel='relevant_recipe_ids')} AS again FROM rec)
        SELECT query_id, gold_rank AS "left", CAST(again AS INTEGER) AS "right", 'differs' AS kind FROM x WHERE gold_rank IS DISTINCT FROM again""",
    "ranking_overlap": """WITH a AS (SELECT query_id, ranked_ids AS a FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recorded_at, len(ranked_ids) DESC, array_to_string(ranked_ids, ',') DESC) AS n FROM query_record) WHERE n = 1),
        b AS (SELECT query_id, ranked_ids AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recorded_at DESC, len(ranked_ids) DESC, array_to_string(ranked_ids, ',') DESC) AS n FROM query_record) WHERE n = 1)
        SELECT count(*) AS queries, count(*) FILTER (a[1] IS NOT DISTINCT FROM b[1]) AS same_first, count(*) FILTER (a[1:10] = b[1:10]) AS same_top,
        round(avg(CASE WHEN len(a) > 0 THEN len(list_distinct(list_filter(a[1:10], lambda x: list_contains(b[1:10], x)))) / len(a[1:10]) WHEN len(b) = 0 THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM a JOIN b USING (query_id)""",
    "rescore_qrels": f"WITH {_REC} SELECT query_id, CAST({_FIRST_PLACE.format(rel='[source_recipe_idx]')} AS INTEGER) AS rank FROM rec",
}
