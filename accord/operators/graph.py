"""Overlap graph: components of matched samples and their annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accord.operators.checkpoints import checkpointed
from accord.operators.tables import global_row_number


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node reachable. Labels hook to the least neighbouring one and paths are halved each round."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    while True:
        labels = checkpointed(labels)
        hook = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b")
            .join(labels.select(F.col("node").alias("a"), "component"), "a")
            .groupBy("component").agg(F.min("other").alias("hook")).filter("hook < component")
        )
        if hook.isEmpty():
            return labels
        hooked = labels.join(hook, "component", "left").select("node", F.coalesce("hook", "component").alias("component"))
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        labels = hooked.join(up, "component", "left").select("node", F.least("component", F.coalesce("upper", "component")).alias("component"))


def node(dataset, obs_id):
    return F.concat_ws("::", dataset, obs_id)


def component_members(edges: DataFrame) -> DataFrame:
    """Members of the components of a_dataset, a_obs_id, b_dataset, b_obs_id edges: node, dataset, obs_id, component."""
    a, b = node(F.col("a_dataset"), F.col("a_obs_id")), node(F.col("b_dataset"), F.col("b_obs_id"))
    labels = connected_components(edges.select(a.alias("a"), b.alias("b")))
    parts = F.split("node", "::", 2)
    return labels.select("node", parts[0].alias("dataset"), parts[1].alias("obs_id"), "component")


def component_table(members: DataFrame, least_datasets: int = 2) -> DataFrame:
    """Components that span enough datasets, numbered by their sorted datasets and members: component_id, n_datasets, n_members, datasets, members."""
    rows = members.groupBy("component").agg(F.array_sort(F.collect_set("dataset")).alias("ds"), F.array_sort(F.collect_set("node")).alias("ms")).filter(F.size("ds") >= least_datasets)
    numbered = global_row_number(rows, "ds", "ms")
    return numbered.select(
        "component",
        F.concat(F.lit("component_"), F.lpad(F.col("n").cast("string"), 5, "0")).alias("component_id"),
        F.size("ds").alias("n_datasets"),
        F.size("ms").alias("n_members"),
        F.array_join("ds", ",").alias("datasets"),
        F.array_join("ms", ",").alias("members"),
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges at each node: node, n_edges."""
    a, b = node(F.col("a_dataset"), F.col("a_obs_id")), node(F.col("b_dataset"), F.col("b_obs_id"))
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_edges"))


def canonical(edges: DataFrame, rank: dict[str, int]) -> DataFrame:
    """Edges with the dataset of lower rank (unknown ones last, by name) on the left."""
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair]) if rank else None
    place = lambda c: F.struct(F.coalesce(order[F.col(c)], F.lit(1 << 30)) if order is not None else F.lit(0), F.col(c))
    swap = place("a_dataset") > place("b_dataset")
    sides = [c[2:] for c in edges.columns if c.startswith("a_")]
    out = edges
    picked = [F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"a_{c}") for c in sides] + [F.when(swap, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"b_{c}") for c in sides]
    rest = [c for c in edges.columns if c[:2] not in ("a_", "b_")]
    return out.select(*rest, *picked)
