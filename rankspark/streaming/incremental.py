"""New files of a folder worked off once each, only what is missing or changed. An extension: the batch form is ingest.pending()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankspark.operators.ingest import pending


def follow(spark: SparkSession, source: str, schema: str, target: str, state: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> None:
    """Read what is new in source (Parquet), do work on rows whose keys target lacks, append to target; then stop.

    state keeps what has been read. A batch that is repeated after a failure finds its rows in target and adds nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.dropDuplicates(keys)
        try:
            done = spark.read.parquet(target)
        except Exception:  # nothing has been written yet
            done = None
        work(rows if done is None else pending(rows, done, keys)).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    stream.awaitTermination()
