"""Relational helpers: numbering, dedupe, top rows, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.operators.checkpoints import checkpointed


def global_row_number(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Running number from 1 over a total order, without one task that holds all rows: ranges are numbered in themselves and moved by the sizes of those before (one number a range goes through the driver)."""
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect())
    before, start = [], 0
    for p, n in sizes:
        before.append((p, start))
        start += n
    offsets = df.sparkSession.createDataFrame(before, "_p int, _before long")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn(name, local).join(F.broadcast(offsets), "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    return top_by(df, keys, 1, *order)


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def keep_last(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Union by name in which later frames override rows of the same key, and within a frame the last by `order` stays."""
    out = frames[0].withColumn("_seq", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_seq", F.lit(i)), allowMissingColumns=True)
    return first_by(out, keys, F.desc("_seq"), F.desc(order)).drop("_seq")


def sampled_by(df: DataFrame, keys: list[str], n: int, seed: int, *identity: str) -> DataFrame:
    """Up to n rows of each key, the same ones on every run with a seed."""
    return top_by(df, keys, n, F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in identity], F.lit(str(seed)))), *identity)


def average_rank(by: list[str], c: str) -> Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0)


def ordered_by_names(df: DataFrame, c: str, names: list[str]) -> DataFrame:
    """place of each row's value in a list of names, unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(c)).cast("int")
    return df.withColumn("place", F.when(place > 0, place).otherwise(len(names) + 1))
