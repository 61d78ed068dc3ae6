"""Command line: python -m accord.cli retrieval|overlap|replicate|summary --help. Tables are Parquet folders; results are CSV or TSV."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from accord.operators import summaries
from accord.plans import workflows as W
from accord.sources.files import read_table, write_table

ALIASES = {"signed": W.SIGNED, "signed_-log10(p)*sign(logfc)": W.SIGNED, "z": W.Z, "z=sign(logfc)*phi^-1(1-p/2)": W.Z}


def names(raw: str, none: tuple[str, ...] = ("all",)) -> tuple[str, ...]:
    """Comma-separated names; the words in `none` stand for no choice."""
    return () if raw.strip().lower() in none else tuple(x.strip() for x in raw.split(",") if x.strip())


def parse_metrics(raw: str) -> tuple[str, ...]:
    if raw.strip().lower() == "all":
        return W.METRICS
    found = tuple(dict.fromkeys(x.lower() for x in names(raw, ())))
    unknown = sorted(set(found) - set(W.METRICS))
    if unknown or not found:
        raise ValueError(f"unknown metrics: {unknown}; known: {list(W.METRICS)}")
    return found


def parse_representations(raw: str) -> tuple[str, ...]:
    return tuple(ALIASES.get(x.lower(), x) for x in names(raw, ("all", "none", "")))


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="accord", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("retrieval", "overlap", "replicate", "summary"):
        s = sub.add_parser(name)
        s.add_argument("--samples", required=True)
        s.add_argument("--output", required=True)
        if name in ("retrieval", "replicate"):
            s.add_argument("--signatures", required=True)
        if name == "retrieval":
            s.add_argument("--features")
            s.add_argument("--query-datasets", default="all")
            s.add_argument("--db-datasets", default="all")
            s.add_argument("--cell-types", default="all")
            s.add_argument("--representations", default="all")
            s.add_argument("--skip-representations", default="none")
            s.add_argument("--metrics", default="all")
            s.add_argument("--include-self-dataset", action="store_true")
            s.add_argument("--split-by-cell-type", action="store_true", help="candidates of the query's cell type only")
        if name == "overlap":
            s.add_argument("--max-log10-dose-diff", type=float, default=1.0)
            s.add_argument("--min-context-overlap-compounds", type=int, default=10)
            s.add_argument("--phase-datasets", default="none")
            s.add_argument("--keep-phase-only-overlaps", action="store_true")
        if name == "replicate":
            s.add_argument("--top-k", type=int, default=50)
            s.add_argument("--min-replicates-per-condition", type=int, default=2)
            s.add_argument("--existing-results", help="output prefix of an earlier run, whose conditions stay unless this run has them")
        if name == "summary":
            s.add_argument("--datasets", default="all")
            s.add_argument("--inventory", action="store_true", help="with system and technology; needs perturbagen, is_control and assay")
            s.add_argument("--no-union-row", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = build_parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    samples = spark.read.parquet(a.samples)
    if a.command == "retrieval":
        known = sorted(r["dataset"] for r in samples.select("dataset").distinct().collect())
        chosen = {}
        for side in ("query", "db"):
            chosen[side] = list(names(getattr(a, f"{side}_datasets")) or known)
            if missing := sorted(set(chosen[side]) - set(known)):
                raise KeyError(f"unknown {side} datasets: {missing}")
        settings = W.RetrievalSettings(parse_metrics(a.metrics), parse_representations(a.representations), parse_representations(a.skip_representations), candidate_scope="same_cell_type" if a.split_by_cell_type else "all")
        features = spark.read.parquet(a.features) if a.features else None
        detail, by_cell, overall = W.run_cross_dataset_retrieval(samples, spark.read.parquet(a.signatures), chosen["query"], chosen["db"], settings, a.include_self_dataset, list(names(a.cell_types)) or None, features)
        for name, df in (("detail", detail), ("summary_by_cell_type", by_cell), ("summary_overall", overall)):
            write_table(df, f"{a.output}_{name}.csv")
    elif a.command == "overlap":
        phase = names(a.phase_datasets, ("none", ""))
        found = W.build_overlap(samples, a.max_log10_dose_diff, a.min_context_overlap_compounds, (phase[0], phase[1]) if len(phase) == 2 else None, a.keep_phase_only_overlaps)
        for name, df in found.items():
            write_table(df, f"{a.output}_{name}.tsv")
    elif a.command == "replicate":
        if a.existing_results == a.output:
            raise ValueError("results can't replace those that they are merged with")
        signatures = spark.read.parquet(a.signatures)
        found = W.replicate_agreement(samples, signatures, a.top_k, a.min_replicates_per_condition)
        if a.existing_results:
            earlier = read_table(spark, f"{a.existing_results}_conditions.tsv", found["conditions"].schema)
            found = W.replicate_agreement(samples, signatures, a.top_k, a.min_replicates_per_condition, earlier)
        for name, df in found.items():
            write_table(df, f"{a.output}_{name}.tsv")
    else:
        chosen = list(names(a.datasets))
        if chosen:
            samples = samples.filter(F.col("dataset").isin(chosen))
        if a.inventory:
            found = summaries.inventory_summary(samples, union=None if a.no_union_row else "all")
        else:
            found = summaries.dataset_summary(samples, not a.no_union_row)
        write_table(found, f"{a.output}_summary.tsv")


if __name__ == "__main__":
    main()
