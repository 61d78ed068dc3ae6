"""End-to-end workflows over samples, signatures and features tables.

samples: dataset, row_pos (unique within a dataset), obs_id, cell_type, cid, time_h, dose_um, and for overlap and inventories
is_control, source_path. signatures: dataset, row_pos, layer, vec. features: dataset, gene_pos, symbol; without it, vectors
of all datasets are taken to be aligned.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accord.functions import blocks, keys
from accord.functions import vectors as V
from accord.operators import graph, matching, replicate, retrieval, summaries, universe
from accord.operators.tables import keep_last
from accord.sources.files import required

METRICS = ("cosine", "pearson", "spearman", "mrrmse")
#: Names of derived representations, and layers that are never scored.
SIGNED, Z = "signed", "z"
EXCLUDED_LAYERS = ("CI.L", "CI.R", "stdev.scaled", "stdev.unscaled", "AveExpr", "adj.P.Value.across_all_contrasts", "adj.P.Value.within_one_contrast")


@dataclass(frozen=True)
class RetrievalSettings:
    """metrics; representations to score (none: all) and to skip; layers left out; bounds of p-values; candidates of the whole database dataset ("all") or of the query's cell type ("same_cell_type")."""

    metrics: tuple[str, ...] = METRICS
    representations: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    excluded_layers: tuple[str, ...] = EXCLUDED_LAYERS
    effect_layer: str = "logFC"
    p_layer: str = "P.Value"
    p_low: float = 1e-300
    p_high: float = 1 - 1e-16
    candidate_scope: str = "all"

    def __post_init__(self):
        unknown = sorted(set(self.metrics) - set(METRICS))
        if unknown or not self.metrics:
            raise ValueError(f"unknown metrics: {unknown}; known: {list(METRICS)}")
        if self.candidate_scope not in ("all", "same_cell_type"):
            raise ValueError(f"unknown candidate scope: {self.candidate_scope}")


def with_derived(signatures: DataFrame, settings: RetrievalSettings) -> DataFrame:
    """signatures and the signed and z representations of samples that have effects and p-values."""
    low, high = settings.p_low, settings.p_high
    e = signatures.filter(F.col("layer") == settings.effect_layer).select("dataset", "row_pos", F.col("vec").alias("e"))
    p = signatures.filter(F.col("layer") == settings.p_layer).select("dataset", "row_pos", F.col("vec").alias("p"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            both = [blocks.signed_and_z(np.array(x, dtype=float), np.array(y, dtype=float), low, high) for x, y in zip(b["e"], b["p"])]
            for k, name in enumerate((SIGNED, Z)):
                yield pd.DataFrame({"dataset": b["dataset"], "row_pos": b["row_pos"], "layer": name, "vec": [x[k] for x in both]})

    derived = e.join(p, ["dataset", "row_pos"]).mapInPandas(run, "dataset string, row_pos long, layer string, vec array<float>")
    return signatures.select("dataset", "row_pos", "layer", "vec").unionByName(derived.select("dataset", "row_pos", "layer", F.col("vec").cast(signatures.schema["vec"].dataType).alias("vec")))


def representations(layers: DataFrame, a: str, b: str, settings: RetrievalSettings) -> list[str]:
    """Representations that both datasets have, less the excluded, unwanted and skipped ones. layers: distinct dataset, layer."""
    known: dict[str, set[str]] = {}
    for r in layers.filter(F.col("dataset").isin(a, b)).collect():
        known.setdefault(r["dataset"], set()).add(r["layer"])
    found = known.get(a, set()) & known.get(b, set()) - set(settings.excluded_layers)
    if settings.representations:
        found &= set(settings.representations)
    return sorted(found - set(settings.skip))


def _aligned(vectors: DataFrame, features: DataFrame | None, a: str, b: str) -> DataFrame | None:
    """Vectors of both datasets on the genes they share; None if there are none."""
    if features is None:
        return vectors
    axis = universe.gene_axis(features.withColumnRenamed("dataset", "source_path"))
    if a == b:
        idx = {a: [r["gene_pos"] for r in axis.filter(F.col("source_path") == a).orderBy("gene_key").collect()]}
    else:
        row = universe.pair_alignment(axis.filter(F.col("source_path").isin(a, b))).first()
        if row is None:
            return None
        idx = {row["a"]: row["idx_a"], row["b"]: row["idx_b"]}
    if not all(idx.values()):
        return None
    place = F.when(F.col("dataset") == a, F.array(*map(F.lit, idx[a]))).otherwise(F.array(*map(F.lit, idx[b])))
    return vectors.withColumn("vec", V.gather(F.col("vec"), place))


def run_cross_dataset_retrieval(samples: DataFrame, signatures: DataFrame, query_datasets: list[str], db_datasets: list[str], settings: RetrievalSettings = RetrievalSettings(), include_self_dataset: bool = False, cell_type_filter: list[str] | None = None, features: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """detail, summary by cell type, overall summary: where each query's nearest equivalent condition ranks among all candidates of each database dataset, by representation and metric."""
    s = samples.filter(keys.valid(F.col("cid"), F.col("time_h"), F.col("dose_um"))).select("dataset", "row_pos", "cell_type", "cid", "time_h", "dose_um")
    if cell_type_filter:
        s = s.filter(F.col("cell_type").isin(cell_type_filter))
    sig = with_derived(signatures, settings)
    layers = sig.select("dataset", "layer").distinct().persist()
    out: DataFrame | None = None
    for a in query_datasets:
        for b in db_datasets:
            if a == b and not include_self_dataset:
                continue
            truth = matching.nearest_match(s.filter(F.col("dataset") == a), s.filter(F.col("dataset") == b), same_dataset=True)
            for rep in representations(layers, a, b, settings):
                v = _aligned(sig.filter((F.col("layer") == rep) & F.col("dataset").isin(a, b)), features, a, b)
                if v is None:
                    continue
                by = ("db_dataset",) if settings.candidate_scope == "all" else ("db_dataset", "cell_type")
                q = truth.join(v.filter(F.col("dataset") == a).select(F.col("row_pos").alias("q_row_pos"), "vec"), "q_row_pos").join(v.filter(F.col("dataset") == b).select(F.col("row_pos").alias("db_row_pos"), F.col("vec").alias("gt_vec")), "db_row_pos")
                pool = s.filter(F.col("dataset") == b).join(v.filter(F.col("dataset") == b).select("row_pos", "vec"), "row_pos").select(F.col("dataset").alias("db_dataset"), "cell_type", F.col("row_pos").alias("row"), "vec")
                key = truth.select(F.col("q_row_pos").alias("q_row"), "db_dataset", "q_dataset", "cid", *(() if "cell_type" in by else ("cell_type",)), F.col("db_row_pos").alias("gt_row"))
                for metric in settings.metrics:
                    counts = retrieval.rank_counts(q.select(*by, F.col("q_row_pos").alias("q_row"), "vec", F.col("db_row_pos").alias("gt_row"), "gt_vec"), pool.select(*by, "row", "vec"), metric, by)
                    rows = retrieval.normalized(counts).join(key, ["q_row", "db_dataset"])
                    part = rows.select("q_dataset", "db_dataset", "cell_type", "cid", F.lit(rep).alias("representation"), F.lit(metric).alias("metric"), "q_row", "gt_row", "gt_score", "n_candidates", "rank", "rank_over_n", "rank_normalized", "retrieval_score")
                    out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no dataset pair shares a representation")
    pair = ["q_dataset", "db_dataset", "representation", "metric"]
    return out, summaries.summarize_retrieval(out, ["q_dataset", "db_dataset", "cell_type", "representation", "metric"]), summaries.summarize_retrieval(out, pair)


def build_overlap(samples: DataFrame, within: float = 1.0, compounds: int = 10, phase: tuple[str, str] | None = None, keep_phase_only: bool = False) -> dict[str, DataFrame]:
    """edges, components, annotations and pair_summary of the samples of all datasets that are the same condition."""
    ok = samples.filter(keys.eligible(keys.is_control(F.col("is_control").cast("string")), F.col("cell_type"), keys.compound_id(F.col("cid")), F.col("time_h"), F.col("dose_um")))
    base = ok.select("dataset", "row_pos", "obs_id", keys.clean_text(F.col("cell_type")).alias("cell_type"), F.col("cid"), "time_h", "dose_um")
    edges = matching.pair_edges(base, within)
    if phase and not keep_phase_only:
        edges = matching.phase_supported(edges, phase)
    normal = matching.qualified(matching.pair_edges(base.withColumn("cid", keys.compound_id(F.col("cid"))), within), ("cell_type",), compounds)
    if phase:
        normal = normal.filter(~((F.least("a_dataset", "b_dataset") == min(phase)) & (F.greatest("a_dataset", "b_dataset") == max(phase))))
    all_edges = edges.unionByName(normal).dropDuplicates(["a_dataset", "b_dataset", "a_obs_id", "b_obs_id", "cid", "cell_type", "time_h"])
    members = graph.component_members(all_edges)
    table = graph.component_table(members)
    notes = members.join(table.select("component", "component_id", "n_datasets", "n_members"), "component").join(graph.edge_counts(all_edges), "node")
    return {"edges": all_edges, "components": table.drop("component"), "annotations": notes.drop("component", "node"), "pair_summary": matching.pair_counts(all_edges)}


def replicate_agreement(samples: DataFrame, signatures: DataFrame, top_k: int = 50, least: int = 2, earlier: DataFrame | None = None) -> dict[str, DataFrame]:
    """pairs, conditions and datasets: agreement of sampled replicate pairs of each condition in logFC and t.

    earlier: conditions of an earlier run, which stay where this run has none of the same key; datasets counts both, pairs are of this run alone.
    """
    kept = replicate.enough_replicates(samples, least)
    ring = replicate.ring_pairs(kept)
    vec = {x: signatures.filter(F.col("layer") == x).select("dataset", "row_pos", V.doubles(F.col("vec")).alias(x)) for x in ("logFC", "t")}
    both = vec["logFC"].join(vec["t"], ["dataset", "row_pos"])
    left = both.select("dataset", F.col("row_pos").alias("left_row"), F.col("logFC").alias("x"), F.col("t").alias("xt"))
    right = both.select("dataset", F.col("row_pos").alias("right_row"), F.col("logFC").alias("y"), F.col("t").alias("yt"))
    rows = ring.join(left, ["dataset", "left_row"]).join(right, ["dataset", "right_row"])

    for a, b in (("x", "y"), ("xt", "yt")):
        left_fine, right_fine = V.pairwise_finite(F.col(a), F.col(b))
        rows = rows.withColumns({a: left_fine, b: right_fine})
    x, y, xt, yt = map(F.col, ("x", "y", "xt", "yt"))
    pairs = rows.select(*replicate.CONDITION, "left_row", "right_row", "n_replicates", V.spearman(x, y).alias("spearman_logfc"), V.spearman(xt, yt).alias("spearman_t"), V.signed_overlap(xt, yt, top_k, False).alias("overlap_t"))
    metrics = ["spearman_logfc", "spearman_t", "overlap_t"]
    conditions = replicate.condition_record(pairs, metrics)
    if earlier is not None:
        conditions = keep_last([required(earlier, conditions.columns).select(*conditions.columns), conditions], list(replicate.CONDITION), "n_pairs")
    means = [f"mean_{m}" for m in metrics]
    datasets = conditions.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_conditions"), F.countDistinct("cid").alias("n_compounds"), F.sum("n_pairs").alias("n_pairs"), *[F.avg(m).alias(m) for m in means])
    return {"pairs": pairs, "conditions": conditions, "datasets": datasets}
