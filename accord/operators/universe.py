"""Gene axes: first-duplicate-wins keys, shared universes and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accord.functions.keys import clean_text


def gene_axis(features: DataFrame) -> DataFrame:
    """source_path, gene_pos, gene_key from source_path, gene_pos, symbol: trimmed, blanks dropped, the first of a repeated key kept."""
    rows = features.select("source_path", "gene_pos", clean_text(F.col("symbol")).alias("gene_key")).filter("gene_key <> ''")
    return rows.groupBy("source_path", "gene_key").agg(F.min("gene_pos").alias("gene_pos"))


def shared_genes(axis: DataFrame, group: str, source: str = "source_path") -> DataFrame:
    """group, gene_key of the keys that every source of a group has."""
    sources = axis.groupBy(group).agg(F.countDistinct(source).alias("n"))
    held = axis.groupBy(group, "gene_key").agg(F.countDistinct(source).alias("m"))
    return held.join(sources, group).filter("m = n").select(group, "gene_key")


def pair_alignment(axis: DataFrame) -> DataFrame:
    """For each two sources: positions of their shared genes in sorted order of the keys, on both sides."""
    a = axis.select(F.col("source_path").alias("a"), "gene_key", F.col("gene_pos").alias("pa"))
    b = axis.select(F.col("source_path").alias("b"), "gene_key", F.col("gene_pos").alias("pb"))
    both = a.join(b, "gene_key").filter("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("gene_key", "pa", "pb"))).alias("g"))
    return both.select("a", "b", F.size("g").alias("n_shared"), F.transform("g", lambda s: s["pa"]).alias("idx_a"), F.transform("g", lambda s: s["pb"]).alias("idx_b"))


def restricted_alignment(axis: DataFrame, dataset: str, least: int) -> DataFrame:
    """Keys that at least so many datasets hold, with the number of datasets."""
    return axis.groupBy("gene_key").agg(F.countDistinct(dataset).alias("n_datasets")).filter(F.col("n_datasets") >= least)


def union_first(frames: list[DataFrame], key: list[str], order: str) -> DataFrame:
    """All frames by name; of rows with one key, that of the earliest frame, then the least `order`."""
    tagged = [f.withColumn("_seq", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("_seq", order))).filter("_rn = 1").drop("_rn", "_seq")
