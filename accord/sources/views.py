"""Samples and signatures as views of the test tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOSES = [0.01, 0.1, 1.0, 10.0, 100.0]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signatures(spark: SparkSession, sf_dir: str, wide: bool = True) -> DataFrame:
    """One row a sample of `embeddings`: keys, and the layers lfc, t and p as arrays of doubles. Unless wide, lfc is as the table has it: for what widens it after a shuffle."""
    i = F.col("vec_id")
    third = lambda n: F.floor(i / n)
    lfc = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select(
        i.alias("row_pos"),
        F.concat(F.lit("s"), i.cast("string")).alias("obs_id"),
        F.element_at(F.array(*map(F.lit, ["ds_a", "ds_b", "ds_c"])), (i % 3 + 1).cast("int")).alias("dataset"),
        F.concat(F.lit("ct_"), (third(3) % 2).cast("string")).alias("cell_type"),
        F.col("label").cast("string").alias("cid"),
        F.when(third(6) % 2 == 0, 6.0).otherwise(24.0).alias("time_h"),
        F.element_at(F.array(*map(F.lit, DOSES)), (i % 5 + 1).cast("int")).alias("dose_um"),
        (lfc if wide else F.col("embedding")).alias("lfc"),
        F.transform(lfc, lambda v, k: v * (k % 4 + 1)).alias("t"),
        F.transform(lfc, lambda v: F.exp(-8.0 * F.abs(v))).alias("p"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(spark, sf_dir).drop("lfc", "t", "p")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: dataset, context, compound, time and dose, without vectors."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_pos"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("obs_id"),
        F.col("event_type").alias("dataset"),
        F.concat(F.lit("ct_"), (F.col("user_id") % 4).cast("string")).alias("cell_type"),
        F.get_json_object("props", "$.k").alias("cid"),
        (F.floor(F.hour("ts") / 6) * 6).cast("double").alias("time_h"),
        F.col("value").alias("dose_um"),
    )


SIGNATURES_SQL = """
signatures AS (
  SELECT vec_id AS row_pos, 's' || vec_id AS obs_id, ['ds_a', 'ds_b', 'ds_c'][vec_id % 3 + 1] AS dataset,
    'ct_' || ((vec_id // 3) % 2) AS cell_type, CAST(label AS VARCHAR) AS cid,
    CASE WHEN (vec_id // 6) % 2 = 0 THEN CAST(6 AS DOUBLE) ELSE CAST(24 AS DOUBLE) END AS time_h,
    CAST([0.01, 0.1, 1.0, 10.0, 100.0][vec_id % 5 + 1] AS DOUBLE) AS dose_um,
    list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS lfc,
    list_transform(embedding, lambda v, k: CAST(v AS DOUBLE) * ((k - 1) % 4 + 1)) AS t,
    list_transform(embedding, lambda v: exp(-8.0 * abs(CAST(v AS DOUBLE)))) AS p
  FROM embeddings
)"""

SAMPLES_SQL = SIGNATURES_SQL + ", samples AS (SELECT row_pos, obs_id, dataset, cell_type, cid, time_h, dose_um FROM signatures)"

EVENTS_SQL = """
ev AS (
  SELECT event_id AS row_pos, 'e' || event_id AS obs_id, event_type AS dataset, 'ct_' || (user_id % 4) AS cell_type,
    json_extract_string(props, '$.k') AS cid, CAST(floor(hour(ts) / 6) * 6 AS DOUBLE) AS time_h, value AS dose_um
  FROM events
)"""
