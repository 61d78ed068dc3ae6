"""Incremental results: new condition rows replace those of the same key, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from accord.operators.tables import keep_last


def merged(spark: SparkSession, current: str | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of the table at `current`, if any, with those of `new` in place of equal keys."""
    return keep_last(([spark.read.parquet(current)] if current else []) + [new], keys, order)


def merge_stream(rows: DataFrame, root: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of the latest row of each key from a stream: batch n writes `root/v<n>` from the version before, so a repeated batch writes the same again."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        merged(spark, f"{root}/v{n - 1}" if n else None, df, keys, order).write.mode("overwrite").parquet(f"{root}/v{n}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
