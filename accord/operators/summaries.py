"""Nested means, grouped rank correlations, inventories and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.functions.keys import finite, is_control, joined_numbers


def summarize_retrieval(detail: DataFrame, by: list[str]) -> DataFrame:
    """Count, and means and medians of pool size, rank and score of each group; null keys are groups."""
    return detail.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg("n_candidates").alias("mean_candidates"),
        F.median("n_candidates").alias("median_candidates"),
        F.avg("rank").alias("mean_rank"),
        F.median("rank").alias("median_rank"),
        F.avg("rank_over_n").alias("mean_rank_over_n"),
        F.avg("rank_normalized").alias("mean_rank_normalized"),
        F.avg("retrieval_score").alias("mean_score"),
        F.median("retrieval_score").alias("median_score"),
    )


def nested_means(rows: DataFrame, levels: list[list[str]], values: list[str]) -> list[DataFrame]:
    """One frame a level: unweighted means of the means of the level before, and n, the number of rows below."""
    out, now = [], rows.withColumn("n", F.lit(1).cast("long"))
    for by in levels:
        now = now.groupBy(*by).agg(F.sum("n").alias("n"), *[F.avg(v).alias(v) for v in values])
        out.append(now)
    return out


def grouped_spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman of two columns in each group over rows where both are known; null for fewer than two rows or distinct values."""
    kept = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranked(c: str):
        w = Window.partitionBy(*by)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0)

    r = kept.withColumn("rx", ranked(x)).withColumn("ry", ranked(y))
    n, sx, sy = F.count(F.lit(1)), F.sum("rx"), F.sum("ry")
    agg = r.groupBy(*by).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.sum(F.col("rx") * F.col("ry")).alias("sxy"), F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy"))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    ok = (F.col("n") >= 2) & (vx > 0) & (vy > 0)
    return agg.select(*by, F.col("n").alias("n_rows"), F.when(ok, cov / F.sqrt(F.when(ok, vx * vy))).alias("spearman"))


def dataset_summary(samples: DataFrame, union: bool = True) -> DataFrame:
    """Compounds, contexts, samples, and the sorted distinct times and doses of each dataset, and (union) of all together."""

    def one(df: DataFrame, name) -> DataFrame:
        texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda v: F.format_string("%.2f", v)), ",")
        return df.groupBy(name.alias("dataset")).agg(F.countDistinct("cid").alias("n_compounds"), F.countDistinct("cell_type").alias("n_contexts"), F.count(F.lit(1)).alias("n_samples"), texts("time_h").alias("times"), texts("dose_um").alias("doses"))

    out = one(samples, F.col("dataset"))
    return out.unionByName(one(samples, F.lit("all"))) if union else out


def _known(c: Column) -> Column:
    """A trimmed text; null where it is blank."""
    t = F.btrim(c.cast("string"))
    return F.when(t != "", t)


def system_label(context: Column, tissue: Column | None = None) -> Column:
    """Aggregate: what the contexts of a dataset are. Cellosaurus ids mean cell lines; blood as the only tissue, PBMC; Cell Ontology ids alone, primary cells; all else, cell lines."""
    context = _known(context)
    blood = F.lit(False) if tissue is None else F.bool_and(_known(tissue) == "blood")
    return (
        F.when(F.bool_or(context.startswith("CVCL_")), "cell lines")
        .when(blood, "primary PBMC")
        .when(F.bool_and(context.startswith("CL_")), "primary cells")
        .otherwise("cell lines")
    )


def inventory_summary(samples: DataFrame, technologies: dict[str, str] = {}, urls: dict[str, str] = {}, union: str | None = "all") -> DataFrame:
    """One row a dataset: system, technology, compounds (controls left out), contexts, samples, distinct times and doses, source URL.

    samples: dataset, cell_type, perturbagen, cid, time_h, dose_um, is_control, assay, and tissue if there is one. More than one assay in a dataset (or
    none) is an error. Blank texts count as absent. technologies and urls name what they hold, other assays stand for themselves and other datasets have NA.
    union: name of a last row over the samples of all datasets that aren't controls, by compound id; None leaves it out.
    """
    control = is_control(F.col("is_control"))
    distinct = lambda c: F.array_sort(F.collect_set(F.when(finite(F.col(c)), F.col(c).cast("double"))))
    counts = [F.countDistinct(_known(F.col("cell_type"))).alias("n_contexts"), F.count(F.lit(1)).alias("n_samples"), distinct("time_h").alias("timepoints_h"), distinct("dose_um").alias("doses_uM")]
    assay = _known(F.col("assay"))
    lookup = lambda names, key: F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key) if names else F.lit(None).cast("string")
    said = lambda df: df.withColumn("timepoints_h", joined_numbers("timepoints_h")).withColumn("doses_uM", joined_numbers("doses_uM"))
    one = samples.groupBy(F.col("dataset").alias("dataset_name")).agg(
        system_label(F.col("cell_type"), F.col("tissue") if "tissue" in samples.columns else None).alias("system"),
        F.when(F.countDistinct(assay) == 1, F.min(assay)).otherwise(F.raise_error(F.lit("one assay a dataset is needed"))).cast("string").alias("_assay"),
        F.countDistinct(F.when(~control, _known(F.col("perturbagen")))).alias("n_compounds"),
        *counts,
    )
    names = ["dataset_name", "system", "technology", "n_compounds", "n_contexts", "n_samples", "timepoints_h", "doses_uM", "source_url"]
    out = one.withColumn("technology", F.coalesce(lookup(technologies, F.col("_assay")), "_assay")).withColumn("source_url", F.coalesce(lookup(urls, F.col("dataset_name")), F.lit("NA"))).select(*names)
    if union is None:
        return said(out)
    cid = _known(F.col("cid"))
    all_of = samples.filter(~control).agg(F.countDistinct(F.when(~F.lower(cid).isin("nan", "none", "<na>"), cid)).alias("n_compounds"), *counts)
    systems = out.agg(F.array_join(F.array_sort(F.collect_set("system")), "; ").alias("system"))
    last = all_of.crossJoin(F.broadcast(systems))  # one row on either side
    return said(out.unionByName(last.select(F.lit(union).alias("dataset_name"), "system", F.lit("union across selected datasets").alias("technology"), *names[3:8], F.lit("NA").alias("source_url"))))


def with_missing(summary: DataFrame, index: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """One row for each row of the index: counts of missing ones are 0, other values null."""
    out = index.join(summary, keys, "left")
    return out.fillna(0, counts)


def share_of_total(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group and their share of all."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def pair_matrix(pairs: DataFrame, a: str, b: str, value: str, names: list[str]) -> DataFrame:
    """Symmetric matrix of a value of unordered pairs: one row a name, one column a name."""
    both = pairs.select(F.col(a).alias("name"), F.col(b).alias("other"), value).unionByName(pairs.select(F.col(b).alias("name"), F.col(a).alias("other"), value))
    return both.groupBy("name").pivot("other", names).agg(F.first(value))


def winners(rows: DataFrame, pair: list[str], config: list[str], value: str) -> DataFrame:
    """Per configuration: mean and median over pairs, pairs won (the best value, ties to the first by name) and the share of them."""
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc(value), *config))).filter("rn = 1")
    wins = best.groupBy(*config).agg(F.count(F.lit(1)).alias("n_wins"))
    n = best.agg(F.count(F.lit(1)).alias("_n"))
    stats = rows.groupBy(*config).agg(F.avg(value).alias("mean_value"), F.median(value).alias("median_value"))
    out = stats.join(wins, config, "left").fillna(0, ["n_wins"]).crossJoin(F.broadcast(n))
    return out.withColumn("win_share", F.col("n_wins") / F.col("_n")).drop("_n")
