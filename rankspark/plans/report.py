"""The evaluation run and its report: configurations, comparisons with corrected p values, cases, profiles and checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import text as X
from rankspark.operators import evaluation as E
from rankspark.operators.engine import Engine
from rankspark.plans import evaluate as V
from rankspark.session import table


@dataclass(frozen=True)
class Config:
    """What a run holds: a mode of search, its level and its group of the ablation."""

    name: str
    mode: str
    group: str
    level: str = "item"


#: The configurations of a run, in the order in which results name them.
REGISTRY = (Config("sparse", "sparse", "A"), Config("dense", "dense", "B"), Config("fusion", "fusion", "C"), Config("hybrid", "hybrid", "D"))
CONFIGS = tuple(c.name for c in REGISTRY)
#: Pairs that are compared within a family, and the configuration compared across families.
PAIRS = (("fusion", "sparse"), ("fusion", "dense"), ("hybrid", "fusion"), ("hybrid", "dense"), ("dense", "sparse"))
ACROSS = "hybrid"
METRICS = ("recall_5", "mrr", "ndcg_10")


def rotated(items: list, n: int) -> list:
    """items from place n on, then those before: each turn of a timed run begins with another."""
    n = n % len(items) if items else 0
    return [*items[n:], *items[:n]]


def run(engine: Engine, strategies: list[str], queries: DataFrame, configs: tuple[Config, ...] = REGISTRY, k: int = 20) -> DataFrame:
    """(config, strategy, query_id, rank, item_id, score) of every configuration on every strategy: one plan for all queries."""
    out = None
    for strategy in strategies:
        for turn, config in enumerate(configs):
            found = engine.search(strategy, queries, config.mode, k, level=config.level).select(F.lit(config.name).alias("config"), F.lit(strategy).alias("strategy"), "query_id", "rank", "item_id", "score")
            out = found if out is None else out.unionByName(found)
    return out


def canonical(rows: DataFrame) -> DataFrame:
    """Rows of a run in the order of reports: query, strategy, place of the configuration in the registry."""
    place = F.create_map(*[F.lit(x) for i, c in enumerate(CONFIGS) for x in (c, i)])
    return rows.orderBy("query_id", "strategy", place[F.col("config")], "rank")


def splice(run_: DataFrame, other: DataFrame, config: str) -> DataFrame:
    """A run with the rows of one configuration taken from another run."""
    return run_.filter(F.col("config") != config).unionByName(other.filter(F.col("config") == config))


def evaluation_run(spark: SparkSession, folder: str) -> DataFrame:
    """All configurations on two chunk profiles with the benchmark's texts as queries, from texts to rankings of recipes."""
    chunks = table(spark, folder, "recipe_chunks").select("chunk_id", "profile_id", "recipe_idx", F.col("chunk_text").alias("content"), F.col("field_name").alias("kind"), F.col("chunk_index").alias("position"), "token_count")
    first = chunks.groupBy("profile_id", "chunk_id").agg(*[F.max_by(c, F.struct("content", "token_count")).alias(c) for c in ("recipe_idx", "content", "kind", "position", "token_count")]).withColumnRenamed("recipe_idx", "item_id")
    engine = Engine({f"profile_{p}": first.filter(F.col("profile_id") == p) for p in (1, 3)})
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return run(engine, ["profile_1", "profile_3"], queries, k=10)


def dense_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """Dense search at recipe level: labels of the vectors stand for recipes, each by its best vector."""
    from rankspark.operators import retrieval as R

    rows = table(spark, folder, "embeddings")
    hits = R.dense(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", 50)
    found = R.collapse(hits.select("query_id", "key", "score"), rows, "vec_id", "label", 10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("item").alias("label"), "score")


def _kinds(spark: SparkSession, folder: str) -> DataFrame:
    """(config, query_id, kind) of the chunk that brought the first right recipe."""
    score = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), -F.col(c))
    orders = F.array(*[F.struct(F.lit(n).alias("config"), o.cast("double").alias("o")) for n, o in (("sparse", F.col("sparse_rank")), ("dense", F.col("dense_rank")), ("fusion", score("rrf_score")), ("hybrid", score("rerank_score")))])
    rows = table(spark, folder, "candidate").filter("recipe_id IS NOT NULL").select("query_id", "recipe_id", "chunk_id", F.coalesce("kind", F.lit("")).alias("kind"), F.inline(orders)).filter("o IS NOT NULL")
    best = rows.groupBy("config", "query_id", "recipe_id").agg(F.min(F.struct("o", "chunk_id", "kind")).alias("b"))
    right = V._lists(spark, folder).join(V._qrels(spark, folder).distinct(), ["query_id", "recipe_id"])
    first = right.groupBy("config", "query_id").agg(F.min(F.struct("rank", "recipe_id")).alias("f")).select("config", "query_id", F.col("f.recipe_id").alias("recipe_id"))
    return first.join(best, ["config", "query_id", "recipe_id"]).select("config", "query_id", F.col("b.kind").alias("kind"))


def best_kind(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of the best chunk of the first right recipe, '' where none is right."""
    configs = F.explode(F.array(*[F.lit(c) for c in CONFIGS])).alias("config")
    every = V._records(spark, folder).select("query_id", configs)
    return every.join(_kinds(spark, folder), ["config", "query_id"], "left").select("config", "query_id", F.coalesce("kind", F.lit("")).alias("best_kind"))


def kinds_by_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Of the queries that fusion answers within 10 and sparse doesn't, or the other way: how often each kind of chunk brought the answer."""
    won = V._pivoted(spark, folder).select("query_id", F.when((F.coalesce("fusion", F.lit(E.MISS)) <= 10) & (F.coalesce("sparse", F.lit(E.MISS)) > 10), "fusion").when((F.coalesce("sparse", F.lit(E.MISS)) <= 10) & (F.coalesce("fusion", F.lit(E.MISS)) > 10), "sparse").alias("config"))
    kinds = ["description", "ingredients", "name"]
    rows = won.filter("config IS NOT NULL").join(_kinds(spark, folder), ["config", "query_id"])
    counted = rows.groupBy(F.col("config").alias("winner")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count_if(~F.col("kind").isin(kinds)).alias("other"))
    return counted


def disagreements(spark: SparkSession, folder: str) -> DataFrame:
    """Five patterns in which configurations disagree at ten: pattern, query_id."""
    hit = lambda c: F.coalesce(F.col(c), F.lit(E.MISS)) <= 10
    patterns = {
        "dense_wins": hit("dense") & ~hit("sparse"), "sparse_wins": hit("sparse") & ~hit("dense"), "fusion_loses_both": hit("sparse") & hit("dense") & ~hit("fusion"),
        "rerank_demotes": hit("fusion") & (F.coalesce(F.col("hybrid"), F.lit(E.MISS)) > F.col("fusion")), "every_miss": ~hit("sparse") & ~hit("dense") & ~hit("fusion") & ~hit("hybrid"),
    }
    found = F.array(*[F.when(c, F.lit(n)) for n, c in patterns.items()])
    return V._pivoted(spark, folder).select("query_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("pattern"))


def per_query(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks of each configuration for every query, its buckets, and whether all configurations miss."""
    a = lambda c: F.coalesce(F.col(c), F.lit(E.MISS))
    buckets = F.array(
        F.when((a("sparse") <= 10) & (a("dense") > 10), F.lit("sparse_win")), F.when((a("dense") <= 10) & (a("sparse") > 10), F.lit("dense_win")),
        F.when((a("fusion") <= 10) & (a("hybrid") > 10), F.lit("rerank_hurt")), F.when((a("hybrid") <= 10) & (a("fusion") > 10), F.lit("rerank_help")),
    )
    miss = F.col("sparse").isNull() & F.col("dense").isNull() & F.col("fusion").isNull() & F.col("hybrid").isNull()
    return V._pivoted(spark, folder).select("query_id", "family", *CONFIGS, F.array_join(buckets, " ").alias("buckets"), miss.alias("every_miss"))


def buckets_in_all(spark: SparkSession, folder: str) -> DataFrame:
    """Families in all of whose queries recorded for a source recipe a bucket holds: bucket, family, recipes, in_all."""
    rows = per_query(spark, folder).join(V._records(spark, folder).select("query_id", "source_recipe_idx"), "query_id")
    own = rows.groupBy("family", "source_recipe_idx").agg(*[F.every(F.contains("buckets", F.lit(b))).alias(b) for b in ("sparse_win", "dense_win", "rerank_hurt", "rerank_help")], F.every("every_miss").alias("every_miss"))
    return own.groupBy("family").agg(F.count("*").alias("recipes"), *[F.count_if(b).alias(b) for b in ("sparse_win", "dense_win", "rerank_hurt", "rerank_help", "every_miss")])


def overlap_split(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of queries all of whose words are in their source recipe, and of the others."""
    recipes = table(spark, folder, "raw_recipes").groupBy(F.col("recipe_idx").alias("source_recipe_idx")).agg(F.max(X.searchable_text(F.col("name"), F.col("ingredients"), F.col("description"))).alias("content"))
    high = (X.word_overlap_unstemmed(F.col("query_text"), F.col("content")) >= 1.0).alias("high")
    split = V._records(spark, folder).join(recipes, "source_recipe_idx").select("query_id", high)
    return E.metrics_table(V._firsts(spark, folder).join(split, "query_id"), ["config", "high"])


def repeat_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Days as repeats of a run: per family and stage the median of the days' p50 and p95, and the least and highest p50."""
    stages = F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_ms").alias("ms")) for s in ("encode", "search")]))
    rows = table(spark, folder, "query_record").select("family", F.to_date("recorded_at").alias("day"), stages).filter("ms IS NOT NULL")
    days = rows.groupBy("family", "stage", "day").agg(F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    p50, p95 = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    out = days.groupBy("family", "stage").agg(F.percentile(p50, F.lit(0.5)).alias("p50"), F.percentile(p95, F.lit(0.5)).alias("p95"), F.min(p50).alias("p50_min"), F.max(p50).alias("p50_max"), F.count("*").alias("days"))
    return out.select("family", "stage", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p50_min", "p50_max")], "days")


def ablation_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Median times of queries with substitutions (the arm) over those without (the default), per stage and family."""
    arm = F.coalesce(F.size("substitutions"), F.lit(0)) > 0
    stages = F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_ms").alias("ms")) for s in ("encode", "search")]))
    rows = table(spark, folder, "query_record").select("family", arm.alias("arm"), stages)
    half = lambda c: F.percentile(F.when(c, F.col("ms")), F.lit(0.5))
    both = rows.groupBy("family", "stage").agg(half(F.col("arm")).alias("a"), half(~F.col("arm")).alias("d"))
    return both.filter("d > 0").select("family", "stage", F.round(F.col("a") / F.col("d"), 6).alias("ratio"))


def headline(spark: SparkSession, folder: str) -> DataFrame:
    """Least, highest and mean of each metric over families, per configuration."""
    means = E.metrics_table(V._firsts(spark, folder), ["config", "family"])
    rows = means.select("config", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])))
    return rows.groupBy("config", "metric").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 4).alias("mean"))


def query_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per family: queries, their words, right recipes per query, and queries with several."""
    n = F.size("relevant_recipe_ids")
    rows = V._records(spark, folder).select("family", X.word_count(F.col("query_text")).alias("words"), F.when(n > 0, n).otherwise(0).alias("right"))
    return rows.groupBy("family").agg(F.count("*").alias("queries"), F.min("words").alias("least_words"), F.max("words").alias("most_words"), F.round(F.avg("words"), 6).alias("mean_words"),
                                      F.round(F.avg("right"), 6).alias("mean_right"), F.max("right").alias("most_right"), F.count_if(F.col("right") > 1).alias("several"))


def category_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Recipes, rated ones and distinct raters' counts per category."""
    rows = table(spark, folder, "recipe").select("id", "category_id", "author_id", "rating", "rating_count").distinct()
    return rows.groupBy("category_id").agg(F.count("*").alias("recipes"), F.countDistinct("author_id").alias("authors"), F.countDistinct(F.when(F.col("rating_count") > 0, F.col("author_id"))).alias("rated_authors"))


def pipeline_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Named checks of a loaded pipeline: check, found, ok. Chunks per recipe, hashes, places, orphans and hits of both searches."""
    chunks = table(spark, folder, "recipe_chunks").distinct()
    known = table(spark, folder, "raw_recipes").select("recipe_idx", F.lit(1).alias("known")).distinct()
    joined = chunks.join(known, "recipe_idx", "left")
    c = joined.agg(
        F.count("*").alias("chunks"), F.count_if(F.col("known").isNull()).alias("orphans"), F.count_if(F.trim(F.coalesce("chunk_text", F.lit(""))) == "").alias("empty"),
        F.count_if(~F.sha2("chunk_text", 256).eqNullSafe(F.col("text_hash"))).alias("stale"), F.countDistinct(F.when(F.col("known").isNotNull(), F.col("recipe_idx"))).alias("covered"),
    )
    hits = table(spark, folder, "candidate").agg(F.count_if(F.col("sparse_rank").isNotNull()).alias("sparse"), F.count_if(F.col("dense_rank").isNotNull()).alias("dense"))
    both = c.crossJoin(F.broadcast(hits))  # one row each
    want = {"chunks": ("chunks", F.col("chunks") > 0), "orphans": ("orphans", F.col("orphans") == 0), "empty_texts": ("empty", F.col("empty") == 0), "stale_hashes": ("stale", F.col("stale") == 0),
            "recipes_covered": ("covered", F.col("covered") > 0), "sparse_hits": ("sparse", F.col("sparse") > 0), "dense_hits": ("dense", F.col("dense") > 0)}
    return both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(v).cast("bigint").alias("found"), ok.alias("ok")) for n, (v, ok) in want.items()])))


def require(checks: DataFrame) -> None:
    """Raise ValueError naming the checks that fail. checks: as pipeline_checks(), one row a check."""
    bad = [f"{r.check} ({r.found})" for r in checks.filter("NOT ok").collect()]
    if bad:
        raise ValueError("failed: " + ", ".join(sorted(bad)))


def raw_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Fields put together as they are: nulls skipped, empty ones kept, white space untouched."""
    return table(spark, folder, "raw_recipes").select("recipe_idx", F.concat_ws(" ", "name", "ingredients", "description").alias("content")).distinct()


def body_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of chunk texts without their first line, in steps of 50."""
    body = F.length("chunk_text") - F.when(F.instr("chunk_text", "\n") > 0, F.instr("chunk_text", "\n")).otherwise(0)
    return table(spark, folder, "recipe_chunks").filter("chunk_text IS NOT NULL").groupBy((F.floor(body / 50) * 50).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def _tests(spark: SparkSession, folder: str, draws: int, seed: int, two_sided: bool) -> DataFrame:
    """Bootstrap tests of PAIRS per family and metric from the histogram of differences, which take few values; with p_holm over all."""
    firsts = V._firsts(spark, folder)
    wide = firsts.groupBy("query_id", "family").agg(*[F.min(F.when(F.col("config") == c, F.col("rank"))).alias(c) for c in CONFIGS])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).alias("metric"), F.round(E.first_rank_metrics(F.col(a))[m] - E.first_rank_metrics(F.col(b))[m], 9).alias("d")) for a, b in PAIRS for m in METRICS]
    counts = wide.select("family", F.inline(F.array(*cells))).groupBy("family", "a", "b", "metric", "d").agg(F.count("*").alias("n")).orderBy("family", "a", "b", "metric", "d").collect()  # differences of ranks up to 20
    groups: dict[tuple, list] = {}
    for r in counts:
        groups.setdefault((r.family, r.a, r.b, r.metric), []).append((r.d, r.n))
    out = []
    for key, pairs in groups.items():
        d, n = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        out.append((*key, int(n.sum()), *E.counted_bootstrap(d, n, draws, seed, two_sided)))
    rows = spark.createDataFrame(out, "family string, a string, b string, metric string, queries long, difference double, low double, high double, p double")
    return E.holm(rows)


def comparison_tests(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison plan: two-sided p values of 10,000 draws, corrected together."""
    return _tests(spark, folder, 10_000, 603, True)


def comparison_tests_one_side(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs by 2,000 draws and twice the share on the side opposite to the observed sign."""
    return _tests(spark, folder, 2000, 42, False)


NAMES = (
    "evaluation_run dense_recipes best_kind kinds_by_bucket disagreements per_query buckets_in_all overlap_split repeat_latency ablation_ratio headline query_profile category_profile "
    "pipeline_checks raw_concat body_length_histogram comparison_tests comparison_tests_one_side"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_HIT = lambda c: f"coalesce({c}, 21) <= 10"
_KINDS = V._FIRSTS + """, ko AS (SELECT query_id, recipe_id, chunk_id, coalesce(kind, '') AS kind, unnest(['sparse', 'dense', 'fusion', 'hybrid']) AS config, unnest([CAST(sparse_rank AS DOUBLE), CAST(dense_rank AS DOUBLE), CASE WHEN NOT isnan(rrf_score) THEN -rrf_score END, CASE WHEN NOT isnan(rerank_score) THEN -rerank_score END]) AS o FROM candidate WHERE recipe_id IS NOT NULL),
    kb AS (SELECT DISTINCT ON (config, query_id, recipe_id) config, query_id, recipe_id, kind FROM ko WHERE o IS NOT NULL ORDER BY config, query_id, recipe_id, o, chunk_id, kind),
    kf AS (SELECT DISTINCT ON (config, query_id) config, query_id, recipe_id FROM lists JOIN qrels USING (query_id, recipe_id) ORDER BY config, query_id, rank),
    kinds AS (SELECT config, query_id, kind FROM kf JOIN kb USING (config, query_id, recipe_id)) """
_BUCKETS = f"""concat_ws(' ', CASE WHEN {_HIT('sparse')} AND NOT {_HIT('dense')} THEN 'sparse_win' END, CASE WHEN {_HIT('dense')} AND NOT {_HIT('sparse')} THEN 'dense_win' END,
    CASE WHEN {_HIT('fusion')} AND NOT {_HIT('hybrid')} THEN 'rerank_hurt' END, CASE WHEN {_HIT('hybrid')} AND NOT {_HIT('fusion')} THEN 'rerank_help' END)"""
_PER_QUERY = f"SELECT query_id, family, sparse, dense, fusion, hybrid, {_BUCKETS} AS buckets, sparse IS NULL AND dense IS NULL AND fusion IS NULL AND hybrid IS NULL AS every_miss FROM pv"
ORACLES = {
    "dense_recipes": """WITH hits AS (SELECT q.vec_id AS query_id, v.vec_id AS key, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
        pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS n FROM hits) WHERE n <= 50), items AS (SELECT query_id, label, max(score) AS score FROM pool GROUP BY ALL)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, label, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM items) WHERE rank <= 10""",
    "best_kind": _KINDS + "SELECT config, query_id, coalesce(kind, '') AS best_kind FROM (SELECT query_id, unnest(['sparse', 'dense', 'fusion', 'hybrid']) AS config FROM rec) LEFT JOIN kinds USING (config, query_id)",
    "kinds_by_bucket": _KINDS + f""", w AS (SELECT query_id, CASE WHEN {_HIT('fusion')} AND NOT {_HIT('sparse')} THEN 'fusion' WHEN {_HIT('sparse')} AND NOT {_HIT('fusion')} THEN 'sparse' END AS config FROM pv)
        SELECT config AS winner, count(*) FILTER (kind = 'description') AS description, count(*) FILTER (kind = 'ingredients') AS ingredients, count(*) FILTER (kind = 'name') AS name,
        count(*) FILTER (kind NOT IN ('description', 'ingredients', 'name')) AS other FROM w JOIN kinds USING (config, query_id) GROUP BY config""",
    "disagreements": V._FIRSTS + f"""SELECT query_id, pattern FROM (SELECT query_id, unnest([CASE WHEN {_HIT('dense')} AND NOT {_HIT('sparse')} THEN 'dense_wins' END, CASE WHEN {_HIT('sparse')} AND NOT {_HIT('dense')} THEN 'sparse_wins' END,
        CASE WHEN {_HIT('sparse')} AND {_HIT('dense')} AND NOT {_HIT('fusion')} THEN 'fusion_loses_both' END, CASE WHEN {_HIT('fusion')} AND coalesce(hybrid, 21) > fusion THEN 'rerank_demotes' END,
        CASE WHEN NOT ({_HIT('sparse')} OR {_HIT('dense')} OR {_HIT('fusion')} OR {_HIT('hybrid')}) THEN 'every_miss' END]) AS pattern FROM pv) WHERE pattern IS NOT NULL""",
    "per_query": V._FIRSTS + _PER_QUERY,
    "buckets_in_all": V._FIRSTS + f", x AS ({_PER_QUERY}), own AS (SELECT x.family, source_recipe_idx, " + ", ".join(f"bool_and(contains(buckets, '{b}')) AS {b}" for b in ("sparse_win", "dense_win", "rerank_hurt", "rerank_help"))
    + ", bool_and(every_miss) AS every_miss FROM x JOIN rec USING (query_id) GROUP BY ALL) SELECT family, count(*) AS recipes, " + ", ".join(f"count(*) FILTER ({b}) AS {b}" for b in ("sparse_win", "dense_win", "rerank_hurt", "rerank_help", "every_miss")) + " FROM own GROUP BY family",
    "repeat_latency": """WITH x AS (SELECT family, CAST(recorded_at AS DATE) AS day, unnest(['encode', 'search']) AS stage, unnest([encode_ms, search_ms]) AS ms FROM query_record),
        d AS (SELECT family, stage, day, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95 FROM x WHERE ms IS NOT NULL GROUP BY ALL)
        SELECT family, stage, round(quantile_cont(p50, 0.5), 6) AS p50, round(quantile_cont(p95, 0.5), 6) AS p95, round(min(p50), 6) AS p50_min, round(max(p50), 6) AS p50_max, count(*) AS days FROM d GROUP BY ALL""",
    "ablation_ratio": """WITH x AS (SELECT family, coalesce(len(substitutions), 0) > 0 AS arm, unnest(['encode', 'search']) AS stage, unnest([encode_ms, search_ms]) AS ms FROM query_record),
        b AS (SELECT family, stage, quantile_cont(ms, 0.5) FILTER (arm) AS a, quantile_cont(ms, 0.5) FILTER (NOT arm) AS d FROM x GROUP BY ALL) SELECT family, stage, round(a / d, 6) AS ratio FROM b WHERE d > 0""",
    "headline": V._FIRSTS + ", x AS (SELECT config, unnest(['recall_5', 'mrr', 'ndcg_10']) AS metric, unnest([recall_5, mrr, ndcg_10]) AS v FROM means) SELECT config, metric, min(v) AS least, max(v) AS most, round(avg(v), 4) AS mean FROM x GROUP BY ALL",
    "query_profile": f"""WITH {V._REC}, x AS (SELECT family, coalesce(len(list_filter(regexp_split_to_array(query_text, '\\s+'), lambda w: w <> '')), 0)::INTEGER AS words, coalesce(len(relevant_recipe_ids), 0)::INTEGER AS r FROM rec)
        SELECT family, count(*) AS queries, min(words) AS least_words, max(words) AS most_words, round(avg(words), 6) AS mean_words, round(avg(r), 6) AS mean_right, max(r) AS most_right, count(*) FILTER (r > 1) AS several FROM x GROUP BY family""",
    "category_profile": """SELECT category_id, count(*) AS recipes, count(DISTINCT author_id) AS authors, count(DISTINCT author_id) FILTER (rating_count > 0) AS rated_authors
        FROM (SELECT DISTINCT id, category_id, author_id, rating, rating_count FROM recipe) GROUP BY category_id""",
    "pipeline_checks": """WITH j AS (SELECT c.*, k.recipe_idx IS NOT NULL AS known FROM (SELECT DISTINCT * FROM recipe_chunks) c LEFT JOIN (SELECT DISTINCT recipe_idx FROM raw_recipes) k ON c.recipe_idx = k.recipe_idx),
        f AS (SELECT unnest(['chunks', 'orphans', 'empty_texts', 'stale_hashes', 'recipes_covered']) AS "check", unnest([count(*), count(*) FILTER (NOT known), count(*) FILTER (trim(coalesce(chunk_text, '')) = ''), count(*) FILTER (sha256(chunk_text) IS DISTINCT FROM text_hash), count(DISTINCT recipe_idx) FILTER (known)]) AS found FROM j
              UNION ALL SELECT 'sparse_hits', count(sparse_rank) FROM candidate UNION ALL SELECT 'dense_hits', count(dense_rank) FROM candidate)
        SELECT "check", found, CASE WHEN "check" IN ('orphans', 'empty_texts', 'stale_hashes') THEN found = 0 ELSE found > 0 END AS ok FROM f""",
    "raw_concat": "SELECT DISTINCT recipe_idx, concat_ws(' ', name, ingredients, description) AS content FROM raw_recipes",
    "body_length_histogram": "SELECT CAST((length(chunk_text) - instr(chunk_text, chr(10))) // 50 * 50 AS BIGINT) AS bin, count(*) AS n FROM recipe_chunks WHERE chunk_text IS NOT NULL GROUP BY 1",
}
