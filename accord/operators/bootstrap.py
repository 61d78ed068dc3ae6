"""Clustered BCa bootstrap of nested means.

The sums and counts of each (group, cluster, stratum) are a native aggregate; only these go to Python, one group at a time.
A group's clusters are a table of its own, bounded by its distinct clusters and strata, not by its rows.
"""

from __future__ import annotations

import hashlib
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESAMPLES, SEED, LEVEL = 2000, 20260505, 0.95
LEAST_CLUSTERS, LEAST_VALID, LEAST_JACKKNIFE = 2, 20, 3

# The statuses of an interval, and the method that each belongs to.
METHODS = {
    "ok": "bca",
    "too_few_clusters_or_values": "not_estimable",
    "nonfinite_observed": "not_estimable",
    "too_few_valid_bootstraps": "not_estimable",
    "zero_bootstrap_variance": "degenerate",
    "too_few_jackknife_values_for_bca": "percentile_fallback",
    "zero_or_nonfinite_bca_acceleration": "percentile_fallback",
    "nonfinite_bca_acceleration": "percentile_fallback",
    "invalid_bca_adjusted_quantile": "percentile_fallback",
}
SCOPE = "observed compound panel"


def cluster_sums(rows: DataFrame, group: list[str], cluster: str, inner: list[str], value: str, outer: list[str] = []) -> DataFrame:
    """total, n of each group, cluster and stratum; rows with a blank cluster or a value that isn't finite are left out."""
    v = F.col(value).cast("double")
    c = F.btrim(F.coalesce(F.col(cluster).cast("string"), F.lit("")))
    kept = rows.filter((c != "") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    strata = list(dict.fromkeys([*outer, *inner]))
    key = lambda names: F.concat_ws("|", *[F.col(x).cast("string") for x in names]) if names else F.lit("")
    return kept.groupBy(*group, c.alias("cluster"), key(strata).alias("stratum"), key(outer).alias("outer")).agg(F.sum(v).alias("total"), F.count(v).alias("n"))


def nested_statistic(totals: np.ndarray, counts: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Rows of (stratum sums, stratum counts) -> mean over outer groups of the means over strata of sum / count; empty strata and groups don't count."""
    with np.errstate(invalid="ignore", divide="ignore"):
        means = np.where(counts > 0, totals / counts, np.nan)
        groups = []
        for o in range(int(outer.max()) + 1 if len(outer) else 0):
            part = means[:, outer == o]
            known = np.isfinite(part)
            groups.append(np.where(known.any(1), np.where(known, part, 0).sum(1) / np.maximum(known.sum(1), 1), np.nan))
        stacked = np.stack(groups, 1) if groups else np.full((len(totals), 1), np.nan)
        known = np.isfinite(stacked)
        return np.where(known.any(1), np.where(known, stacked, 0).sum(1) / np.maximum(known.sum(1), 1), np.nan)


def bca(totals: np.ndarray, counts: np.ndarray, outer: np.ndarray, seed: int, resamples: int = RESAMPLES, level: float = LEVEL) -> dict:
    """Interval of the nested mean from cluster x stratum sums and counts."""
    n = len(totals)
    estimate = float(nested_statistic(totals.sum(0)[None], counts.sum(0)[None], outer)[0])
    out = {"estimate": estimate if np.isfinite(estimate) else None, "low": None, "high": None, "n_clusters": n, "n_rows": int(counts.sum()), "n_valid": 0, "z0": None, "acceleration": None, "status": "ok"}
    if n < LEAST_CLUSTERS:
        return out | {"estimate": None, "status": "too_few_clusters_or_values"}
    if not np.isfinite(estimate):
        return out | {"status": "nonfinite_observed"}
    random = np.random.default_rng(seed)
    weights = np.zeros((resamples, n))
    draws = random.integers(0, n, (resamples, n))
    np.add.at(weights, (np.repeat(np.arange(resamples), n), draws.ravel()), 1)
    values = nested_statistic(weights @ totals, weights @ counts, outer)
    values = values[np.isfinite(values)]
    out["n_valid"] = len(values)
    if len(values) < LEAST_VALID:
        return out | {"status": "too_few_valid_bootstraps"}
    if np.ptp(values) <= 1e-15 * max(1.0, abs(estimate)):
        return out | {"low": estimate, "high": estimate, "status": "zero_bootstrap_variance"}
    tail = (1 - level) / 2
    percentile = {"low": float(np.quantile(values, tail)), "high": float(np.quantile(values, 1 - tail))}
    jack = nested_statistic(totals.sum(0)[None] - totals, counts.sum(0)[None] - counts, outer)
    jack = jack[np.isfinite(jack)]
    if len(jack) < LEAST_JACKKNIFE:
        return out | percentile | {"status": "too_few_jackknife_values_for_bca"}
    edge = 1 / (2 * len(values))
    below = min(max(float((values < estimate).mean()), edge), 1 - edge)
    centered = jack.mean() - jack
    spread = float((centered**2).sum()) ** 1.5
    if not 0 < spread < float("inf"):
        return out | percentile | {"status": "zero_or_nonfinite_bca_acceleration"}
    normal = NormalDist()
    z0, a = normal.inv_cdf(below), float((centered**3).sum()) / (6 * spread)
    if not np.isfinite(a):
        return out | percentile | {"status": "nonfinite_bca_acceleration"}
    ends = []
    for p in (tail, 1 - tail):
        z = z0 + normal.inv_cdf(p)
        scale = 1 - a * z
        if scale <= 0:
            return out | percentile | {"status": "invalid_bca_adjusted_quantile"}
        ends.append(normal.cdf(z0 + z / scale))
    low, high = sorted(float(np.quantile(values, x)) for x in ends)
    return out | {"low": low, "high": high, "z0": z0, "acceleration": a}


def stable_seed(*parts: object, base: int = SEED) -> int:
    digest = hashlib.blake2b(repr(parts).encode(), digest_size=8).digest()
    return (base + int.from_bytes(digest, "big")) % (2**32 - 1)


def bca_table(rows: DataFrame, group: list[str], cluster: str, inner: list[str], values: list[str], outer: list[str] = [], resamples: int = RESAMPLES, level: float = LEVEL) -> DataFrame:
    """One row a group and metric: estimate, low, high, half_width, clusters, rows, valid resamples, bias, acceleration, status. Clusters and strata are sorted first, so the partitioning of the rows doesn't matter."""
    long = rows.select(*dict.fromkeys([*group, cluster, *outer, *inner]), F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select("*", "x.metric", "x.value").drop("x")
    sums = cluster_sums(long, [*group, "metric"], cluster, inner, "value", outer)
    names = [*group, "metric"]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["cluster", "outer", "stratum"])
        clusters = sorted(part["cluster"].unique())
        strata = sorted(set(zip(part["outer"], part["stratum"])))
        at_c, at_s = {c: i for i, c in enumerate(clusters)}, {s: i for i, s in enumerate(strata)}
        totals, counts = np.zeros((len(clusters), len(strata))), np.zeros((len(clusters), len(strata)))
        for c, o, s, t, n in zip(part["cluster"], part["outer"], part["stratum"], part["total"], part["n"]):
            totals[at_c[c], at_s[o, s]], counts[at_c[c], at_s[o, s]] = t, n
        outers = {o: i for i, o in enumerate(sorted({o for o, _ in strata}))}
        key = tuple(part[c].iloc[0] for c in names)
        found = bca(totals, counts, np.array([outers[o] for o, _ in strata]), stable_seed(*map(str, key)), resamples, level)
        half = None if found["low"] is None else (found["high"] - found["low"]) / 2
        return pd.DataFrame([dict(zip(names, key)) | found | {"half_width": half}])

    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in names)
    return sums.groupBy(*names).applyInPandas(one, f"{kinds}, estimate double, low double, high double, n_clusters long, n_rows long, n_valid long, z0 double, acceleration double, status string, half_width double")


def interval_table(rows: DataFrame, group: list[str], cluster: str, inner: list[str], values: dict[str, str], outer: list[str] = [], summary_level: str = "all", scope: str = SCOPE, resamples: int = RESAMPLES, level: float = LEVEL) -> DataFrame:
    """The whole record of each group and metric (values: metric -> column): mean, interval, its method and status, counts and settings.

    Null keys are groups. A group without two clusters, or without any finite value, has its row too, with nulls for mean and interval; so
    n_rows counts all rows of a group, n_finite_rows those that enter. No group at all gives no row.
    """
    renamed = rows.select(*dict.fromkeys([*group, cluster, *outer, *inner]), *[F.col(c).alias(f"_{m}") for m, c in values.items()])
    found = bca_table(renamed, group, cluster, inner, [f"_{m}" for m in values], outer, resamples, level)
    labels = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("value_col")) for m, c in values.items()]))
    asked = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_all")).filter("n_all > 0").withColumn("x", labels).select(*group, "x.metric", "x.value_col", "n_all")
    b = found.select(*[F.col(c).alias(f"_{c}") for c in [*group, "metric"]], *[c for c in found.columns if c not in {*group, "metric"}])
    on = F.concat(F.lit("_"), F.col("metric")) == F.col("_metric")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.coalesce("status", F.lit("too_few_clusters_or_values"))
    method = F.element_at(F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair]), status)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return asked.join(b, on, "left").select(
        *group,
        F.lit(summary_level).alias("summary_level"),
        "metric",
        "value_col",
        F.col("estimate").alias("mean"),
        F.col("low").alias("ci_low"),
        F.col("high").alias("ci_high"),
        F.col("half_width").alias("ci_half_width"),
        method.alias("ci_method"),
        status.alias("ci_status"),
        F.lit(float(level)).alias("ci_level"),
        F.lit(resamples).cast("long").alias("n_bootstrap_iterations"),
        zero("n_valid").alias("n_bootstrap_valid"),
        F.col("n_all").alias("n_rows"),
        zero("n_rows").alias("n_finite_rows"),
        zero("n_clusters").alias("n_compounds"),
        F.lit(cluster).alias("cluster_col"),
        F.lit(",".join(inner)).alias("inner_strata"),
        F.lit(",".join(outer)).alias("outer_strata"),
        F.lit(scope).alias("uncertainty_scope"),
    )


def half_width_ranges(table: DataFrame, by: list[str] = ["summary_level", "metric"]) -> DataFrame:
    """Of the intervals of each group with a finite half width: number, least, median and largest half width, fewest and most compounds, sorted methods and statuses."""
    width = F.col("ci_half_width").cast("double")
    sorted_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return table.filter(width.isNotNull() & ~F.isnan(width) & (F.abs(width) < float("inf"))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_intervals"),
        F.min(width).alias("min_ci_half_width"),
        F.median(width).alias("median_ci_half_width"),
        F.max(width).alias("max_ci_half_width"),
        F.min("n_compounds").alias("min_n_compounds"),
        F.max("n_compounds").alias("max_n_compounds"),
        sorted_set("ci_method").alias("ci_methods"),
        sorted_set("ci_status").alias("ci_statuses"),
    )
