"""The N best items of every group.

Plain SQL: the best score of each item, a row_number window ordered by score and identifier, and a rank filter. The
optimiser turns the filter into WindowGroupLimit operators, so each task keeps N rows a group before the shuffle by
group, and a group of any size arrives as N rows a task. The aggregation before it is keyed by group and item, so it
spreads a large group over all tasks and combines map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 10) -> DataFrame:
    """(group_key, rank_no from 1, item, score): the n items of highest score in every group.

    An item's score is the highest of its rows; equal scores go by smaller item. Rows with a null or NaN score or a null
    item don't count, and a group of only such rows has no row; a null group is a group like any other; -0.0 equals 0.0.
    Repeated rows change nothing; an empty table gives no row; other columns of rows don't matter.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    named = rows.select(F.col(group).alias("group_key"), F.col(item).alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"))
    return rows.sparkSession.sql(
        """
        WITH best AS (
            SELECT group_key, item, max(score) AS score FROM {named}
            WHERE score IS NOT NULL AND NOT isnan(score) AND item IS NOT NULL
            GROUP BY group_key, item
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY score DESC, item) AS rank_no FROM best
        )
        SELECT group_key, rank_no, item, score FROM ranked WHERE rank_no <= """
        + str(int(n)),
        named=named,
    )


def top_lists(rows: DataFrame, group: str, item: str, score: str, n: int = 10) -> DataFrame:
    """(group_key, ranked_ids, top_scores): the rows of top_n() as one pair of lists a group, at most n long."""
    best = top_n(rows, group, item, score, n)
    pairs = F.array_sort(F.collect_list(F.struct("rank_no", "item", "score")))  # at most n a group
    lists = best.groupBy("group_key").agg(pairs.alias("p"))
    return lists.select("group_key", F.col("p.item").alias("ranked_ids"), F.col("p.score").alias("top_scores"))
