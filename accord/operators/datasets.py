"""Indexes of datasets, choice of layers and files, reports of rejected rows, shards of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accord.functions import keys as K
from accord.operators.checkpoints import checkpointed
from accord.operators.tables import first_by, global_row_number

CONDITION = ("dataset", "cell_type", "cid", "time_h")


def adjusted_layer(within: Column, across: Column, row: Column) -> tuple[Column, Column]:
    """Name and vector of the adjusted p-values of a row: within one contrast if there are any, else across all; a row with neither is an error that names it."""
    error = F.raise_error(F.concat(F.lit("no adjusted p-values for row "), row.cast("string")))
    name = F.when(within.isNotNull(), "within").when(across.isNotNull(), "across").otherwise(error.cast("string"))
    return name, F.coalesce(within, across)


def adjusted_vectors(rows: DataFrame, vectors: DataFrame, within: str, across: str) -> DataFrame:
    """rows (row_pos, ...) with layer and adjusted, from vectors (row_pos, layer, vec)."""
    found = vectors.filter(F.col("layer").isin(within, across)).groupBy("row_pos").agg(*[F.first(F.when(F.col("layer") == x, F.col("vec")), ignorenulls=True).alias(n) for n, x in (("_w", within), ("_a", across))])
    name, vec = adjusted_layer(F.col("_w"), F.col("_a"), F.col("row_pos"))
    return rows.join(found, "row_pos", "left").withColumn("layer", name).withColumn("adjusted", vec).drop("_w", "_a")


def file_stem(path: Column) -> Column:
    """The cell type that a file name hints at: its last part without the extension, the mark `_de` and a number behind an underscore."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(_de)?\.h5ad$", ""), r"_[0-9]+(\.[0-9]+)?$", "")


def first_files(paths: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """path -> stem, file: the first file of each cell type by name, of the allowed cell types if given."""
    named = paths.select(file_stem(F.col("path")).alias("stem"), F.col("path").alias("file")).distinct()
    return first_by(named if allowed is None else named.filter(F.col("stem").isin(allowed)), ["stem"], "file")


def dataset_index(rows: DataFrame, condition: tuple[str, ...] = CONDITION, least: int = 2, cell_types: list | None = None, line_compounds: DataFrame | None = None, condition_keys: DataFrame | None = None) -> DataFrame:
    """Conditions with enough replicates and their number n, of the allowed cell types, (cell type, compound) pairs and conditions, where those are given."""
    kept = rows if cell_types is None else rows.filter(F.col("cell_type").isin(cell_types))
    if line_compounds is not None:
        kept = kept.join(line_compounds.select("cell_type", "cid").distinct(), ["cell_type", "cid"], "left_semi")
    if condition_keys is not None:
        kept = kept.join(condition_keys.select(*condition).distinct(), list(condition), "left_semi")
    return kept.groupBy(*condition).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def required_index(index: DataFrame, name: str) -> DataFrame:
    """The index; an empty one is an error."""
    if index.isEmpty():
        raise ValueError(f"no condition of {name} has enough replicates")
    return index


def bridge_rows(rows: DataFrame, key: str, name: str, group: str, controls: list[str]) -> DataFrame:
    """Rows whose group is no control, with cleaned texts: key, name, segment."""
    return rows.filter(~F.lower(group).isin(controls)).select(key, F.lower(K.clean_text(F.col(name))).alias("name"), K.clean_text(F.col(group)).alias("segment"))


def unique_positions(features: DataFrame) -> DataFrame:
    """dataset, positions: the first position of every gene key, in order of position; repeated keys keep their first."""
    first = features.groupBy("dataset", "gene_key").agg(F.min("gene_pos").alias("gene_pos"))
    return first.groupBy("dataset").agg(F.array_sort(F.collect_list("gene_pos")).alias("positions"))


def retained(rows: DataFrame, phase: str, by: tuple[str, ...] = ("cell_type", "cid")) -> DataFrame:
    """Distinct (dataset, keys) and whether they are evaluated: always outside the phase dataset, within it if another dataset has the keys."""
    support = rows.filter(F.col("dataset") != phase).select(*by).distinct().withColumn("_other", F.lit(True))
    out = rows.select("dataset", *by).distinct().join(support, list(by), "left")
    return out.withColumn("retained", (F.col("dataset") != phase) | F.coalesce("_other", F.lit(False))).drop("_other")


def rejected(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """The rows for which some condition holds, with the first such reason."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(reasons.items()):
        reason = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason).filter("reason is not null")


def count_mismatches(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose numbers (columns expected and observed; absent: 0) differ."""
    return expected.join(observed, keys, "outer").fillna(0, ["expected", "observed"]).filter("expected <> observed")


def shards(conditions: DataFrame, most: int, files: str = "source_path", order: tuple[str, ...] = CONDITION) -> DataFrame:
    """conditions with shard: numbers from 1 of runs of at most `most` conditions of one set of files, in order."""
    place = F.row_number().over(Window.partitionBy(files).orderBy(*order)) - 1
    dealt = conditions.withColumn("_run", F.floor(place / most))
    numbered = global_row_number(dealt.select(files, "_run").distinct(), files, "_run", name="shard")
    return dealt.join(numbered, [files, "_run"]).drop("_run")


def missing_tasks(expected: DataFrame, produced: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Expected tasks without output; strict: any is an error."""
    out = expected.select(*keys).distinct().join(produced.select(*keys).distinct(), keys, "left_anti")
    if strict and not out.isEmpty():
        raise FileNotFoundError(f"{out.count()} tasks have no output")
    return out


def merged_outputs(expected: DataFrame, outputs: list[DataFrame], keys: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """All rows that tasks have given, and the tasks that gave none."""
    whole = outputs[0]
    for more in outputs[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole, missing_tasks(expected, whole, keys, strict)


def match_samples(doses: DataFrame, samples: DataFrame, keys: tuple[str, ...] = ("cid", "cell_type", "time_h")) -> DataFrame:
    """samples that pairs of doses (see matching.dose_edges) match, with other and match_ids: the sorted, comma-joined obs_ids of the other dataset's samples.

    Samples of one dose have the same ids, so those are joined to a text once a dose. Only samples whose obs_id repeats within
    a dataset gather the ids of several doses.
    """
    by, order = list(keys), F.array_sort
    at = [*by, "dataset", "dose_um"]
    ids = samples.groupBy(*at).agg(F.collect_list("obs_id").alias("ids"))

    def side(x: str, y: str) -> DataFrame:
        pairs = doses.select(*by, F.col(f"{x}_dataset").alias("own"), F.col(f"{x}_dose_um").alias("own_dose"), F.col(f"{y}_dataset").alias("dataset"), F.col(f"{y}_dose_um").alias("dose_um"))
        lists = pairs.join(ids, at).groupBy(*by, F.col("own").alias("dataset"), F.col("dataset").alias("other"), F.col("own_dose").alias("dose_um")).agg(F.flatten(F.collect_list("ids")).alias("ids"))
        return lists.select("dataset", "other", *by, "dose_um", "ids")

    lists = side("a", "b").union(side("b", "a"))
    others = doses.select(*by, F.col("a_dataset").alias("dataset"), F.col("b_dataset").alias("other"), F.col("a_dose_um").alias("dose_um"))
    others = others.union(doses.select(*by, "b_dataset", "a_dataset", "b_dose_um")).distinct()
    repeated = samples.groupBy("dataset", "obs_id").count().filter("count > 1").select("dataset", "obs_id")
    once, many = samples, None
    if not repeated.isEmpty():
        once, many = samples.join(repeated, ["dataset", "obs_id"], "left_anti"), samples.join(repeated, ["dataset", "obs_id"], "left_semi")
    keyed = ["dataset", "other", *by, "dose_um"]
    columns = [*samples.columns, "other", "match_ids"]
    # Sorted by dataset and other as they come out of the last join: a writer by those needs no sort of the long texts.
    out = once.join(others, at).join(lists.withColumn("match_ids", F.array_join(order("ids"), ",")).drop("ids").hint("merge"), keyed).select(columns)
    if many is None:
        return out
    texts = many.join(others, at).join(lists, keyed).groupBy("dataset", "other", "obs_id").agg(F.array_join(order(F.flatten(F.collect_list("ids"))), ",").alias("match_ids"))
    return out.union(texts.join(many, ["dataset", "obs_id"]).select(columns))


def write_match_samples(doses: DataFrame, samples: DataFrame, folder: str) -> str:
    """Matched samples with their match ids, a folder for each (dataset, other)."""
    match_samples(doses, samples).write.mode("overwrite").partitionBy("dataset", "other").parquet(folder)
    return folder


def filtered_export(samples: DataFrame, found: DataFrame, control: Column) -> DataFrame:
    """samples whose row_pos is among the `found` ones, and controls of a dataset, cell type and time that holds such a one, with the reason why they stay."""
    m = checkpointed(found.select("row_pos").distinct())  # it is met three times
    matched = samples.join(m, "row_pos", "left_semi")
    contexts = matched.select("dataset", "cell_type", "time_h").distinct()
    controls = samples.filter(control).join(m, "row_pos", "left_anti").join(contexts, ["dataset", "cell_type", "time_h"], "left_semi")
    return matched.withColumn("reason", F.lit("matched")).unionByName(controls.withColumn("reason", F.lit("control")))


def write_filtered(samples: DataFrame, found: DataFrame, control: Column, folder: str) -> DataFrame:
    """filtered_export() written, a folder for each dataset; returns the numbers kept: dataset, reason, n."""
    filtered_export(samples, found, control).write.mode("overwrite").partitionBy("dataset").parquet(folder)
    back = samples.sparkSession.read.parquet(folder)
    return back.groupBy("dataset", "reason").agg(F.count(F.lit(1)).alias("n"))
