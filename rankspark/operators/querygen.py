"""Query sets: stratified samples, rare terms, families from disjoint sources, near-equal term sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Term sets of more terms than this aren't joined less each of their terms, which takes n rows of n terms.
SHORT = 16


def stratified_quotas(rows: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, size, quota): n places shared out in proportion, the rest by largest remainder, ties by stratum."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    shared = sizes.join(F.broadcast(total)).withColumns({"quota": F.expr(f"({n} * size) div total"), "rest": F.expr(f"({n} * size) % total")})  # total is one row
    left = n - F.sum("quota").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), F.asc(stratum)))  # one row per stratum
    return shared.withColumn("left", left).withColumn("place", place).select(stratum, "size", (F.col("quota") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def stratified_sample(rows: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """(key, stratum): as many rows of each stratum as its quota, by a seeded hash of the key; input order doesn't matter."""
    quotas = stratified_quotas(rows, stratum, n).select(stratum, "quota")
    ranked = rows.select(key, stratum).withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)))
    return ranked.filter(F.col("__r") <= n).join(quotas, stratum).filter(F.col("__r") <= F.col("quota")).select(key, stratum)


def rare_terms(terms: DataFrame, key: str, term: str, least: int = 2, share: float = 0.10, k: int = 4) -> DataFrame:
    """(key, term, df, place): the k rarest terms of each key among those of at least `least` and at most `share` of all keys."""
    distinct = terms.select(key, term).distinct()
    df = distinct.groupBy(term).agg(F.count("*").alias("df"))
    total = distinct.agg(F.countDistinct(key).alias("total"))
    kept = df.join(F.broadcast(total)).filter((F.col("df") >= least) & (F.col("df") <= share * F.col("total"))).select(term, "df")  # total is one row
    place = F.row_number().over(Window.partitionBy(key).orderBy("df", term))
    return distinct.join(kept, term).withColumn("place", place).filter(F.col("place") <= k)


def _similar_long(sets: DataFrame, threshold: float, short: int) -> DataFrame:
    """(ta, tb): pairs of different term sets (n, terms) with Jaccard >= threshold of which one has more than `short` terms.

    Terms are ordered from rare to frequent over all sets; two similar sets share a term among their first
    n - ceil(threshold * n) + 1, so only those are joined, with a size filter; the verdict is exact.
    """
    own = sets.filter(F.col("n") >= threshold * (short + 1) - 1e-9).distinct()
    flat = own.select("terms", "n", F.explode("terms").alias("term"))
    df = flat.groupBy("term").agg(F.count("*").alias("df"))
    placed = flat.join(df, "term").withColumn("place", F.row_number().over(Window.partitionBy("terms").orderBy("df", "term")))
    prefix = placed.filter(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).select("terms", "n", "term")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9) & (F.greatest("a.n", "b.n") > short) & (F.col("a.terms") < F.col("b.terms"))
    both = F.size(F.array_intersect("a.terms", "b.terms"))
    return a.join(b, (F.col("a.term") == F.col("b.term")) & near).filter(both / (F.col("a.n") + F.col("b.n") - both) >= threshold).select(F.col("a.terms").alias("ta"), F.col("b.terms").alias("tb")).distinct()


def similar_term_sets(sets: DataFrame, key: str, terms: str, threshold: float = 0.8, least: int = 3) -> DataFrame:
    """(key_a, key_b, both, similarity): pairs of keys whose term sets (least terms or more) have Jaccard >= threshold.

    Keys of equal sets are one class from the start. While (n - 1) / (n + 1) < threshold, two different sets of n terms at
    most can only be similar if one is the other without one term; so each such set is joined, less each of its terms in
    turn, with the class of just these terms. No other pair is looked at. Larger sets go through _similar_long(). Exact.
    """
    short = 0
    while short < SHORT and short / (short + 2) < threshold:
        short += 1
    least = max(least, 1)
    less = [n for n in range(least + 1, short + 1) if (n - 1) / n >= threshold]
    own = sets.select(F.col(key).alias("key"), F.sort_array(F.array_distinct(F.coalesce(terms, F.array()))).alias("terms")).filter(F.size("terms") >= least)
    classes = own.groupBy("terms").agg(F.collect_set("key").alias("keys"), F.max(F.size("terms")).alias("n"))

    def expanded(pairs: DataFrame, similarity: Column) -> DataFrame:
        """pairs(ka, kb, both): two lists of keys."""
        rows = pairs.withColumn("similarity", similarity).withColumn("ka", F.explode("ka")).withColumn("kb", F.explode("kb"))
        return rows.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "both", "similarity").filter("key_a < key_b")

    equal = classes.filter(F.size("keys") > 1).select("keys", F.explode("keys").alias("key_a"), F.col("n").alias("both"))
    found = equal.select("key_a", F.explode("keys").alias("key_b"), "both", F.lit(1.0).alias("similarity")).filter("key_a < key_b")
    if less:
        larger = classes.filter(F.col("n").isin(less)).select(F.explode(F.transform("terms", lambda t: F.array_remove("terms", t))).alias("terms"), F.col("keys").alias("kb"))
        pairs = classes.select("terms", F.col("keys").alias("ka"), F.col("n").alias("both")).join(larger, "terms").drop("terms")
        found = found.unionByName(expanded(pairs, F.col("both") / (F.col("both") + 1)))
    far = _similar_long(own.select("terms", F.size("terms").alias("n")), threshold, short)
    far = far.join(classes.select(F.col("terms").alias("ta"), F.col("keys").alias("ka")), "ta").join(classes.select(F.col("terms").alias("tb"), F.col("keys").alias("kb")), "tb")
    far = far.select("ka", "kb", F.size(F.array_intersect("ta", "tb")).alias("both"), (F.size("ta") + F.size("tb")).alias("sizes"))
    return found.unionByName(expanded(far, F.col("both") / (F.col("sizes") - F.col("both"))))


def disjoint_families(sources: dict[str, DataFrame], key: str, per_family: int, seed: int = 42) -> DataFrame:
    """(family, key): per_family keys for each family in turn, none used by an earlier one. A loop over the families only."""
    used, out = None, None
    for family, rows in sources.items():
        own = rows.select(key).distinct()
        if used is not None:
            own = own.join(used, key, "left_anti")
        picked = own.orderBy(F.xxhash64(F.lit(seed), F.lit(family), key), key).limit(per_family).select(F.lit(family).alias("family"), key)
        out = picked if out is None else out.unionByName(picked)
        used = out.select(key)
    return out
