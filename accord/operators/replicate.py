"""Replicates of a condition: sampled pairs, pair scores and condition records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StructField, StructType

CONDITION = ("dataset", "cell_type", "cid", "time_h", "dose_um")


def ring_pairs(rows: DataFrame, condition: tuple[str, ...] = CONDITION, order: str = "row_pos") -> DataFrame:
    """Sampled pairs of a condition's replicates: none for one, (0, 1) for two, the ring (i, i + 1 mod n) beyond; columns condition..., left_row, right_row, n_replicates."""
    keys = list(condition)
    w = Window.partitionBy(*keys)
    numbered = rows.select(*keys, order).withColumn("n_replicates", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy(order)) - 1)
    pairs = numbered.withColumn("right_row", F.coalesce(F.lead(order).over(w.orderBy(order)), F.first(order).over(w.orderBy(order))))
    kept = pairs.filter((F.col("n_replicates") > 2) | ((F.col("n_replicates") == 2) & (F.col("i") == 0)))
    return kept.select(*keys, F.col(order).alias("left_row"), "right_row", "n_replicates")


@udtf(returnType=StructType([StructField("left", IntegerType()), StructField("right", IntegerType())]))
class RingPairs:
    """SELECT * FROM ring_pairs(n): the sampled index pairs of n replicates."""

    def eval(self, n: int) -> Iterator[tuple[int, int]]:
        if n == 2:
            yield 0, 1
        elif n > 2:
            for i in range(n):
                yield i, (i + 1) % n


def condition_record(pairs: DataFrame, metrics: list[str], condition: tuple[str, ...] = CONDITION) -> DataFrame:
    """Mean, median and number of defined values of each metric over a condition's pairs."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.median(m).alias(f"median_{m}"), F.count(m).alias(f"n_{m}")]
    return pairs.groupBy(*condition).agg(F.max("n_replicates").alias("n_replicates"), F.count(F.lit(1)).alias("n_pairs"), *aggs)


def inventory(rows: DataFrame, condition: tuple[str, ...] = CONDITION) -> DataFrame:
    """Replicates, sampled and possible pairs, and the sorted sources of each condition."""
    n = F.count(F.lit(1))
    out = rows.groupBy(*condition).agg(n.alias("n_replicates"), F.array_join(F.array_sort(F.collect_set("source_path")), "||").alias("sources"), F.min("obs_id").alias("label"))
    k = F.col("n_replicates")
    sampled = F.when(k < 2, 0).when(k == 2, 1).otherwise(k)
    return out.withColumn("n_sampled_pairs", sampled.cast("long")).withColumn("n_possible_pairs", F.floor(k * (k - 1) / 2).cast("long"))


def enough_replicates(rows: DataFrame, least: int = 2, condition: tuple[str, ...] = CONDITION) -> DataFrame:
    keys = list(condition)
    return rows.join(rows.groupBy(*keys).count().filter(F.col("count") >= least).drop("count"), keys, "left_semi")
