"""Data lifecycle: dimensions, upserts, anti-joins, incremental work, completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankspark.session import use_checkpoints


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by order (which must be total to be the same in every run)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def dense_ids(values: DataFrame, column: str, name: str = "id") -> DataFrame:
    """(column, id): the distinct non-null values numbered from 1 in their order, without bringing them to one task."""
    use_checkpoints(values.sparkSession)
    own = values.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("__p", F.spark_partition_id()).checkpoint()
    counts = own.groupBy("__p").agg(F.count("*").alias("__c"))  # one row per partition
    before = counts.withColumn("__b", F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).select("__p", "__b")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(column))
    return own.withColumn("__r", inside).join(F.broadcast(before), "__p").select(column, (F.col("__b") + F.col("__r")).cast("bigint").alias(name))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in the place of those of equal keys. Keys are unique in new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def delete_stale(old: DataFrame, stage: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of old whose keys the stage has."""
    return old.join(stage.select(*keys), keys, "left_semi")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of wanted that are missing from done or changed since: keys include a content hash, never null."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that only one of the two has."""
    return a.subtract(b).unionAll(b.subtract(a))


def differing(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys of both whose columns differ, null-safely and as one row value."""
    x, y = a.select(*keys, F.struct(*columns).alias("x")), b.select(*keys, F.struct(*columns).alias("y"))
    return x.join(y, keys).filter(~F.col("x").eqNullSafe(F.col("y"))).select(*keys)


def staging_problems(chunks: DataFrame, items: DataFrame, by: str, item: str, text: str, place: str) -> DataFrame:
    """Per `by`: rows, items, rows without text, rows of no known item, items whose places have gaps or repeats, longest text."""
    known = chunks.join(items.select(item, F.lit(True).alias("known")).distinct(), item, "left")
    gaps = chunks.groupBy(by, item, "field_name").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.countDistinct(place).alias("d"))
    gaps = gaps.groupBy(by).agg(F.count_if((F.col("a") != 0) | (F.col("z") != F.col("d") - 1)).alias("gaps"))
    main = known.groupBy(by).agg(
        F.count("*").alias("rows"), F.countDistinct(item).alias("items"), F.count_if(F.coalesce(F.trim(F.col(text)), F.lit("")) == "").alias("empty"),
        F.count_if(F.col("known").isNull()).alias("unknown"), F.max(F.length(text)).alias("longest"),
    )
    return main.join(gaps, by)


def ordered_text(rows: DataFrame, key: str, place: str, line: str, separator: str = "; ") -> DataFrame:
    """(key, text, lines): the lines of a key in order of place, as one string and as an array; null lines skipped.

    A key's lines are collected together, as its result is their list; that is as large as the key's own text.
    """
    own = rows.filter(F.col(line).isNotNull())
    lines = F.transform(F.array_sort(F.collect_list(F.struct(place, line))), lambda s: s[line])
    return own.groupBy(key).agg(lines.alias("lines")).withColumn("text", F.array_join("lines", separator))
