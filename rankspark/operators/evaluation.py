"""Evaluation: rankings against relevant ids, latency, failures, comparisons and their statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEPTH = 20
MISS = DEPTH + 1


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order, which must be total."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def best_rows(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """All rows that share the first place of their key."""
    return rows.withColumn("__n", F.rank().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Share of all relevant ids in the first k; 0 without relevant ids."""
    return F.when(F.size(relevant) > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), relevant)) / F.size(F.array_distinct(relevant))).otherwise(0.0)


def reciprocal_rank(ranked: Column, relevant: Column) -> Column:
    """1 / place of the first relevant id, 0 if none."""
    places = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def ndcg_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Binary gains over the ideal of min(k, relevant ids) hits, 0 without relevant ids."""
    gain = F.aggregate(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.size(relevant)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return F.when(F.size(relevant) > 0, gain / ideal).otherwise(0.0)


def unique_depth(run: DataFrame, keys: list[str], item: str, order: str, depth: int = DEPTH) -> DataFrame:
    """The first `depth` different items of each list by first appearance: keys, item, rank from 1. order: smaller is earlier."""
    first = run.groupBy(*keys, item).agg(F.min(order).alias("__o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__o", item))).filter(F.col("rank") <= depth).drop("__o")


def first_ranks(lists: DataFrame, qrels: DataFrame, every: DataFrame, item: str = "recipe_id") -> DataFrame:
    """(config, query_id, rank): the first right rank for each row of every(config, query_id); null where there is none."""
    right = lists.join(qrels.select("query_id", item).distinct(), ["query_id", item]).groupBy("config", "query_id").agg(F.min("rank").alias("rank"))
    return every.join(right, ["config", "query_id"], "left")


def first_rank_metrics(rank: Column) -> dict[str, Column]:
    """Recall@5/10/20, MRR, nDCG@5/10 of a first right rank; a null rank is a miss."""
    hit = lambda k: F.when(rank <= k, 1.0).otherwise(0.0)
    gain = lambda k: F.when(rank <= k, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)
    return {"recall_5": hit(5), "recall_10": hit(10), "recall_20": hit(20), "mrr": F.coalesce(1.0 / rank, F.lit(0.0)), "ndcg_5": gain(5), "ndcg_10": gain(10)}


def metrics_table(firsts: DataFrame, by: list[str]) -> DataFrame:
    """Means of first_rank_metrics() and the number of queries."""
    return firsts.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(n) for n, c in first_rank_metrics(F.col("rank")).items()])


def latency(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """p50 and p95 by linear interpolation; and p95 as the sorted value at int(0.95 n). Null times don't count; none gives 0."""
    n = F.count(column)
    groups = rows.groupBy(*by).agg(n.alias("n"), F.percentile(column, F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    # the value at a place: few different times a group are counted, and their running count tells it; no list of a group is made
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(column))
    placed = counts.withColumn("upto", upto).join(groups.select(*by, "n"), by)
    at = placed.filter(F.col("upto") >= F.least(F.col("n"), F.floor(F.col("n") * 0.95) + 1)).groupBy(*by).agg(F.min(column).alias("p95_at"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = groups.join(at, by, "left")
    return out.select(*by, F.round(zero(F.get("p", F.lit(0))), 6).alias("p50"), F.round(zero(F.get("p", F.lit(1))), 6).alias("p95"), zero(F.col("p95_at")).alias("p95_at"))


def unit_bin(value: Column, width: float = 0.1) -> Column:
    """Bin 0 to 9 of a share; exactly 1 or more is bin 10."""
    return F.when(value >= 1.0, 10).otherwise(F.floor(value / width)).cast("int")


def failure_buckets(ranks: DataFrame, first: str, second: str, near: int = 10) -> DataFrame:
    """(query_id, bucket): first_win where only `first` has it within `near`, second_win the other way; a miss is rank 21."""
    a, b = F.coalesce(F.col(first), F.lit(MISS)), F.coalesce(F.col(second), F.lit(MISS))
    bucket = F.when((a <= near) & (b > near), F.lit(f"{first}_win")).when((b <= near) & (a > near), F.lit(f"{second}_win"))
    return ranks.select("query_id", bucket.alias("bucket")).filter("bucket IS NOT NULL")


def net_effect(ranks: DataFrame, before: str, after: str) -> DataFrame:
    """How a second stage moves the first right rank: hurt, help, same, top 5 left and entered, median drop, top 20 left and entered."""
    a, b = F.coalesce(F.col(before), F.lit(MISS)), F.coalesce(F.col(after), F.lit(MISS))
    n = lambda c: F.count_if(c)
    return ranks.agg(
        n(b > a).alias("hurt"), n(b < a).alias("help"), n(a == b).alias("same"), n((a <= 5) & (b > 5)).alias("top5_left"), n((a > 5) & (b <= 5)).alias("top5_entered"),
        (n((a > 5) & (b <= 5)) - n((a <= 5) & (b > 5))).alias("top5_net"),
        F.percentile(F.when(b > a, b - a), F.lit(0.5)).alias("median_drop"), n((a <= DEPTH) & (b > DEPTH)).alias("top20_left"), n((a > DEPTH) & (b <= DEPTH)).alias("top20_entered"),
    )


def holm(tests: DataFrame, p: str = "p", family: str | None = None) -> DataFrame:
    """tests with p_holm: the k-th least p times (m - k + 1), never falling, at most 1. Within each family, if one is named."""
    part = [F.col(family)] if family else [F.lit(1)]
    ordered = Window.partitionBy(*part).orderBy(p)
    raw = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy(*part)) - F.row_number().over(ordered) + 1))
    return tests.withColumn("__raw", raw).withColumn("p_holm", F.round(F.max("__raw").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), 9)).drop("__raw")


def rank_mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two runs whose values differ, or that one of them lacks: keys, left, right, kind."""
    x, y = a.select(*keys, F.col(value).alias("left"), F.lit(True).alias("in_a")), b.select(*keys, F.col(value).alias("right"), F.lit(True).alias("in_b"))
    kind = F.when(F.col("in_a").isNull(), "extra").when(F.col("in_b").isNull(), "missing").otherwise("differs")
    return x.join(y, keys, "full").filter(~(F.col("left").eqNullSafe(F.col("right")) & F.col("in_a").eqNullSafe(F.col("in_b")))).select(*keys, "left", "right", kind.alias("kind"))


def ranking_overlap(both: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """Queries, identical first ids, identical first k, and the mean share of the first k in common."""
    x, y = F.slice(a, 1, k), F.slice(b, 1, k)
    share = F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.when(F.size(y) == 0, 1.0).otherwise(0.0))
    return both.agg(F.count("*").alias("queries"), F.count_if(F.get(x, F.lit(0)).eqNullSafe(F.get(y, F.lit(0)))).alias("same_first"), F.count_if(x == y).alias("same_top"), F.round(F.avg(share), 6).alias("overlap"))


def rescore(lists: DataFrame, ids: str, qrels: DataFrame, item: str = "recipe_id") -> DataFrame:
    """(query_id, rank): the first right place in stored id lists under another answer key; null if none is right."""
    placed = lists.select("query_id", F.posexplode(ids).alias("p", item))
    right = placed.join(qrels.select("query_id", item).distinct(), ["query_id", item]).groupBy("query_id").agg((F.min("p") + 1).alias("rank"))
    return lists.select("query_id").join(right, "query_id", "left")


def bootstrap_interval(values: np.ndarray, draws: int = 2000, seed: int = 42, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high) by percentiles of resampled means; zeros for no values. Values are per query, hence few."""
    if not len(values):
        return 0.0, 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = values[rng.integers(0, len(values), (draws, len(values)))].mean(1)
    low, high = np.percentile(means, [50 * (1 - level), 100 - 50 * (1 - level)])
    return float(values.mean()), float(low), float(high)


def paired_bootstrap(candidate: np.ndarray, baseline: np.ndarray, draws: int = 10_000, seed: int = 603, two_sided: bool = True) -> tuple[float, float, float, float]:
    """(difference, low, high, p). two_sided: p = 2 min(P(<= 0), P(>= 0)); else twice the share on the side opposite to the
    observed sign. At most 1; all-equal pairs give 1."""
    difference = candidate - baseline
    if not len(difference) or not difference.any():
        return 0.0, 0.0, 0.0, 1.0
    rng = np.random.default_rng(seed)
    means = np.concatenate([difference[rng.integers(0, len(difference), (500, len(difference)))].mean(1) for _ in range(draws // 500)])
    low, high = np.percentile(means, [2.5, 97.5])
    share = min((means <= 0).mean(), (means >= 0).mean()) if two_sided else ((means <= 0).mean() if difference.mean() > 0 else (means >= 0).mean())
    return float(difference.mean()), float(low), float(high), float(min(1.0, 2 * share))


def counted_bootstrap(values: np.ndarray, counts: np.ndarray, draws: int = 10_000, seed: int = 603, two_sided: bool = True) -> tuple[float, float, float, float]:
    """As paired_bootstrap(), of differences that take few values, each with its number: for any number of pairs."""
    total = counts.sum()
    if not total or not values[counts > 0].any():
        return 0.0, 0.0, 0.0, 1.0
    means = np.random.default_rng(seed).multinomial(int(total), counts / total, draws) @ values / total
    observed = float(values @ counts / total)
    low, high = np.percentile(means, [2.5, 97.5])
    share = min((means <= 0).mean(), (means >= 0).mean()) if two_sided else ((means <= 0).mean() if observed > 0 else (means >= 0).mean())
    return observed, float(low), float(high), float(min(1.0, 2 * share))


def poisson_bootstrap(rows: DataFrame, by: list[str], key: str, value: str, draws: int = 200) -> DataFrame:
    """(by, low, high): percentile interval of the mean for any number of rows: each row counts Poisson(1) times in each draw,
    by a hash of key and draw; only sums per draw leave the tasks."""
    u = (F.pmod(F.xxhash64(F.col(key), F.col("draw")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    edges = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    times = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    sums = rows.select(*by, key, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).groupBy(*by, "draw").agg((F.sum(times * F.col(value)) / F.sum(times)).alias("m"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return sums.groupBy(*by).agg(F.get(p, F.lit(0)).alias("low"), F.get(p, F.lit(1)).alias("high"))
