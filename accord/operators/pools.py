"""Retrieval pools of a context: which contexts are large enough, who is in them, and which candidates are positive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accord.operators.matching import TOLERANCE, renamed

CONTEXT = ("cell_type", "time_h")
#: Rows and compounds that a pool needs, and the log10-dose difference up to which doses are alike.
LEAST_ROWS, LEAST_COMPOUNDS, DOSE_WITHIN = 5, 2, 1.0
TOO_FEW = "insufficient_candidates_or_unique_compounds"


def stratum_sizes(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """n_compounds and n_rows of each stratum."""
    return rows.groupBy(*by).agg(F.countDistinct("cid").alias("n_compounds"), F.count(F.lit(1)).alias("n_rows"))


def large_strata(rows: DataFrame, by: tuple[str, ...], compounds: int = LEAST_COMPOUNDS, least: int = LEAST_ROWS) -> DataFrame:
    """The strata with so many compounds and rows, and their sizes."""
    return stratum_sizes(rows, by).filter((F.col("n_compounds") >= compounds) & (F.col("n_rows") >= least))


def context_pairs(left: DataFrame, right: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """Contexts that both sides have: sizes of both pools, and `reason`, null where both are large enough. Contexts are reported, never dropped."""
    sides = [stratum_sizes(rows, context).select(*context, F.col("n_rows").alias(f"n_{name}_conditions"), F.col("n_compounds").alias(f"n_{name}_compounds")) for name, rows in (("left", left), ("right", right))]
    both = sides[0].join(sides[1], list(context))
    fine = F.lit(True)
    for name in ("left", "right"):
        fine = fine & (F.col(f"n_{name}_conditions") >= LEAST_ROWS) & (F.col(f"n_{name}_compounds") >= LEAST_COMPOUNDS)
    return both.withColumn("reason", F.when(~fine, F.lit(TOO_FEW)))


def assembled(pool: DataFrame, vectors: DataFrame, layers: list[str], baselines: dict[str, DataFrame] | None = None, stratum: tuple[str, ...] = ("dataset", "cell_type", "time_h")) -> DataFrame:
    """The rows of a pool with their vectors, one column a layer, and `error`, null where every layer was found.

    vectors: row_pos, layer, vec. baselines: by layer, the frames of baseline.baselines(); they add <layer>_baseline (null
    without peers). Rows that lack a layer stay, with the names of the missing layers as their error.
    """
    found = vectors.filter(F.col("layer").isin(layers)).groupBy("row_pos").pivot("layer", layers).agg(F.first("vec"))
    out = pool.join(found, "row_pos", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(x).isNull(), F.lit(x)) for x in layers]))
    out = out.withColumn("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))))
    for layer, base in (baselines or {}).items():
        out = out.join(base.select(*stratum, "cid", F.col("baseline").alias(f"{layer}_baseline")), [*stratum, "cid"], "left")
    return out


def candidate_pairs(queries: DataFrame, candidates: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """query_id, candidate_id, the context, and cid and dose of both, of all pairs in a context that is large enough on both sides: keys only, no vectors."""
    fine = context_pairs(queries, candidates, context).filter("reason is null").select(*context)
    q = renamed(queries.select("row_pos", "cid", "dose_um", *context), "q_", context)
    c = renamed(candidates.select("row_pos", "cid", "dose_um", *context), "c_", context)
    met = q.join(fine, list(context), "left_semi").join(c, list(context))
    return met.withColumnsRenamed({"q_row_pos": "query_id", "c_row_pos": "candidate_id"})


def with_positives(pairs: DataFrame, strict: DataFrame | None = None) -> DataFrame:
    """Pairs with primary (same compound), dose_aware (same compound within DOSE_WITHIN in log10 dose, else the nearest doses, ties kept) and, given edges (query_id, candidate_id), strict (a mutual-nearest pair)."""
    primary = F.col("q_cid") == F.col("c_cid")
    diff = F.when(primary, F.abs(F.log10("c_dose_um") - F.log10("q_dose_um")))
    own = Window.partitionBy("query_id")
    out = pairs.withColumn("primary", primary).withColumn("_diff", diff).withColumn("_least", F.min("_diff").over(own))
    near = (F.col("_diff") <= DOSE_WITHIN + TOLERANCE) | ((F.col("_least") > DOSE_WITHIN + TOLERANCE) & (F.abs(F.col("_diff") - F.col("_least")) <= TOLERANCE))
    out = out.withColumn("dose_aware", F.coalesce(F.col("primary") & near, F.lit(False))).drop("_diff", "_least")
    if strict is None:
        return out
    marked = strict.select("query_id", "candidate_id").distinct().withColumn("strict", F.lit(True))
    return out.join(marked, ["query_id", "candidate_id"], "left").withColumn("strict", F.coalesce("strict", F.lit(False)))


def strict_edges(edges: DataFrame) -> DataFrame:
    """Mutual-nearest edges as (query_id, candidate_id) in both directions."""
    forth = edges.select(F.col("a_row_pos").alias("query_id"), F.col("b_row_pos").alias("candidate_id"))
    return forth.unionByName(edges.select(F.col("b_row_pos").alias("query_id"), F.col("a_row_pos").alias("candidate_id")))


def random_reference(best: DataFrame) -> DataFrame:
    """What a random order would score on the pools of retrieval.best_positive_rank(): recall at 1 is the share of positives, rank and AUROC are a half."""
    return best.withColumn("recall_random", F.col("n_positive") / F.col("n_pool")).withColumn("rank_random", F.lit(0.5)).withColumn("auroc_random", F.lit(0.5))
