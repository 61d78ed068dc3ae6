"""Remaining entries of the inventory: indexes, representations, all-pairs scores, DEG records with baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from accord.functions import vectors as V
from accord.functions.keys import mean_available
from accord.operators import baseline, datasets, pairs, retrieval
from accord.plans import fragments as S
from accord.plans import workflows
from accord.plans.fragments import WITH_EVENTS, WITH_SAMPLES, WITH_SIGNATURES, edges_sql, truth_sql
from accord.plans.metrics import DEG_LFC, DEG_P, KEYS, LEFT_SPEARMAN, LOO, MASKS, RIGHT_SPEARMAN, matched, rank_correlation
from accord.plans.rankings import rank_sql
from accord.plans.registry import query, r, rounded
from accord.sources import files
from accord.sources.views import event_samples, read, samples, signatures


@query("src1_dataset_partitions", WITH_EVENTS + " SELECT dataset, cell_type, count(*) AS n FROM ev WHERE dataset = 'view' GROUP BY ALL")
def _(s, d):
    path = files.exchange_folder(s)
    event_samples(s, d).write.partitionBy("dataset", "cell_type").parquet(path)
    back = s.read.schema("row_pos long, obs_id string, cid string, time_h double, dose_um double, dataset string, cell_type string").parquet(path)
    return back.filter("dataset = 'view'").groupBy("dataset", "cell_type").agg(F.count(F.lit(1)).alias("n"))


@query("src8_group_indexes", WITH_EVENTS + " SELECT dataset, cid, cell_type, time_h, count(*) AS n_rows, min(row_pos) AS first_row, count(DISTINCT dose_um) AS n_doses FROM ev WHERE dose_um > 0 GROUP BY ALL")
def _(s, d):
    e = event_samples(s, d).filter("dose_um > 0")
    return e.groupBy("dataset", "cid", "cell_type", "time_h").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_pos").alias("first_row"), F.countDistinct("dose_um").alias("n_doses"))


@query("src13_adjusted_vectors", WITH_SIGNATURES + f" SELECT row_pos, CASE WHEN row_pos % 2 = 0 THEN 'within' ELSE 'across' END AS layer, {r('CASE WHEN row_pos % 2 = 0 THEN list_min(p) ELSE list_min(p) / 2 END', 'least_p')}, CAST(len(list_filter(p, lambda v: CASE WHEN row_pos % 2 = 0 THEN v ELSE v / 2 END < 0.25)) AS BIGINT) AS n_below FROM signatures WHERE cell_type = 'ct_0'")
def _(s, d):
    g = signatures(s, d)
    long = g.filter("row_pos % 2 = 0").select("row_pos", F.lit("in_one").alias("layer"), F.col("p").alias("vec"))
    long = long.unionByName(g.select("row_pos", F.lit("over_all").alias("layer"), F.transform("p", lambda v: v / 2).alias("vec")))
    got = datasets.adjusted_vectors(g.filter("cell_type = 'ct_0'").select("row_pos"), long, "in_one", "over_all")
    return rounded(got.select("row_pos", "layer", F.array_min("adjusted").alias("least_p"), F.size(F.filter("adjusted", lambda v: v < 0.25)).cast("long").alias("n_below")), "least_p")


@query("src21_cached_index", WITH_EVENTS + " SELECT dataset, cell_type, cid, time_h, count(*) AS n FROM ev GROUP BY ALL")
def _(s, d):
    path = files.exchange_folder(s) + ".tsv"
    index = event_samples(s, d).groupBy("dataset", "cell_type", "cid", "time_h").agg(F.count(F.lit(1)).alias("n"))
    files.write_table(index, path)
    return files.read_optional(s, path, "dataset string, cell_type string, cid string, time_h double, n long")


@query("src23_unique_gene_vector", WITH_SIGNATURES + f" SELECT row_pos, {r('lfc[1] + lfc[2] + lfc[4]', 'total')} FROM signatures WHERE dataset = 'ds_b'")
def _(s, d):
    # Position 2 repeats the gene of position 1: the first stays.
    features = s.createDataFrame([("ds_b", 0, "g0"), ("ds_b", 1, "g1"), ("ds_b", 2, "g1"), ("ds_b", 3, "g3"), ("ds_a", 0, "g9")], "dataset string, gene_pos int, gene_key string")
    got = signatures(s, d).filter("dataset = 'ds_b'").join(datasets.unique_positions(features), "dataset")
    return rounded(got.select("row_pos", V.total(V.gather(F.col("lfc"), F.col("positions"))).alias("total")), "total")


@query("snk7_overwrite", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def _(s, d):
    path = files.exchange_folder(s) + ".csv"
    table = read(s, d, "region").select(F.col("r_regionkey").cast("int"), "r_name")
    files.write_table(table, path)
    files.write_table(table.filter("r_regionkey > 1"), path)
    return files.read_table(s, path, "r_regionkey int, r_name string")


@query("joi7_all_pairs", f"{WITH_SIGNATURES}, x AS (SELECT q.cell_type, {S.cosine('q.lfc', 'd.lfc')} AS s FROM signatures q JOIN signatures d ON q.dataset = 'ds_a' AND d.dataset = 'ds_b' AND q.cell_type = d.cell_type) SELECT cell_type, count(s) AS n, {r('avg(s)', 'mean_score')}, {r('max(s)', 'best')} FROM x GROUP BY ALL")
def _(s, d):
    g = signatures(s, d).select("dataset", "cell_type", F.col("row_pos").alias("id"), F.col("lfc").alias("vec"))
    q, c = g.filter("dataset = 'ds_a'").drop("dataset"), g.filter("dataset = 'ds_b'").drop("dataset")
    return rounded(retrieval.score_summary(q, c, ("cell_type",)), "mean_score", "best")


@query("rnk2_rank_normalisation", f"{rank_sql('mrrmse')} SELECT q_row, db_dataset, rank, {r('rank_over_n', 'rank_over_n')}, {r('rank_normalized', 'rank_normalized')} FROM detail")
def _(s, d):
    out = retrieval.retrieval_detail(signatures(s, d), "lfc", "mrrmse")
    return rounded(out.select("q_row", "db_dataset", "rank", "rank_over_n", "rank_normalized"), "rank_over_n", "rank_normalized")


@query("rnk12_representations", "SELECT unnest(['P.Value', 'logFC', 'signed', 't', 'z']) AS representation")
def _(s, d):
    g = signatures(s, d)
    long = None
    for column, layer in (("lfc", "logFC"), ("p", "P.Value"), ("t", "t"), ("lfc", "CI.L")):
        part = g.select("dataset", "row_pos", F.lit(layer).alias("layer"), F.col(column).alias("vec"))
        long = part if long is None else long.unionByName(part)
    settings = workflows.RetrievalSettings()
    layers = workflows.with_derived(long, settings).select("dataset", "layer").distinct()
    found = workflows.representations(layers, "ds_a", "ds_b", settings)
    return s.createDataFrame([(x,) for x in found], "representation string")


@query("rnk13_metric_dispatch", f"{rank_sql('mrrmse')} SELECT 'mrrmse' AS metric, count(*) AS n_queries, CAST(sum(rank) AS BIGINT) AS rank_sum FROM detail")
def _(s, d):
    out = retrieval.retrieval_detail(signatures(s, d), "lfc", "mrrmse")
    return out.groupBy("metric").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("rank").alias("rank_sum"))


@query("shd1_truth_summary", f"{WITH_SAMPLES}, {truth_sql('samples')} SELECT q_dataset, db_dataset, count(*) AS n_matches, count(DISTINCT q_row_pos) AS n_queries, count(DISTINCT cid) AS n_compounds FROM truth GROUP BY ALL")
def _(s, d):
    from accord.operators import matching

    t = matching.nearest_match(samples(s, d), samples(s, d))
    return t.groupBy("q_dataset", "db_dataset").agg(F.count(F.lit(1)).alias("n_matches"), F.countDistinct("q_row_pos").alias("n_queries"), F.countDistinct("cid").alias("n_compounds"))


BASE_A = f"CASE WHEN bx IS NOT NULL AND len(list_filter(mx, lambda b: b)) >= 2 THEN {rank_correlation(S.masked('x', 'mx'), S.masked('bx', 'mx'))} END"
BASE_B = f"CASE WHEN byy IS NOT NULL AND len(list_filter(my, lambda b: b)) >= 2 THEN {rank_correlation(S.masked('y', 'my'), S.masked('byy', 'my'))} END"


@query("vec25_deg_record_with_baseline", f"""{LOO}, samples AS (SELECT * EXCLUDE (lfc, t, p) FROM signatures), {edges_sql('samples')},
v AS (SELECT e.a_row_pos, e.b_row_pos, a.lfc AS x, b.lfc AS y, a.p AS xp, b.p AS yp, ba.b AS bx, bb.b AS byy FROM edges e JOIN signatures a ON a.row_pos = a_row_pos JOIN signatures b ON b.row_pos = b_row_pos LEFT JOIN base ba ON ba.dataset = e.a_dataset AND ba.cell_type = e.cell_type AND ba.time_h = e.time_h AND ba.cid = e.cid LEFT JOIN base bb ON bb.dataset = e.b_dataset AND bb.cell_type = e.cell_type AND bb.time_h = e.time_h AND bb.cid = e.cid),
{MASKS}, q AS (SELECT a_row_pos, b_row_pos, ({LEFT_SPEARMAN} + {RIGHT_SPEARMAN}) / 2 AS o, {BASE_A} AS l, {BASE_B} AS rr FROM m),
z AS (SELECT *, CASE WHEN l IS NOT NULL AND rr IS NOT NULL THEN (l + rr) / 2 ELSE coalesce(l, rr) END AS b FROM q)
SELECT a_row_pos, b_row_pos, {r('o', 'observed')}, {r('b', 'baseline')}, {r('o - b', 'delta')} FROM z""")
def _(s, d):
    sig = signatures(s, d)
    base = baseline.baselines(sig, "lfc", KEYS).select(*KEYS, "cid", "baseline")
    m = pairs.with_masks(matched(s, d, ("lfc", "p")), DEG_P, DEG_LFC)
    for side in ("a", "b"):
        named = base.select(F.col("dataset").alias(f"{side}_dataset"), "cell_type", "time_h", "cid", F.col("baseline").alias(f"{side}_base"))
        m = m.join(named, [f"{side}_dataset", "cell_type", "time_h", "cid"], "left")
    score = lambda x: V.spearman(V.masked(F.col(f"{x}_lfc"), F.col(f"{x}_m")), V.masked(F.col(f"{x}_base"), F.col(f"{x}_m")))
    out = m.withColumn("observed", pairs.deg_scores()["spearman_symmetric"]).withColumn("baseline", mean_available(F.when(F.col("a_base").isNotNull(), score("a")), F.when(F.col("b_base").isNotNull(), score("b")))).withColumn("delta", F.col("observed") - F.col("baseline"))
    return rounded(out.select("a_row_pos", "b_row_pos", "observed", "baseline", "delta"), "observed", "baseline", "delta")
