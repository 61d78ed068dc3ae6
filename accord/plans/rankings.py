"""Retrieval ranks, nested summaries, replicates and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from accord.functions import vectors as V
from accord.operators import baseline, bootstrap, datasets, matching, pools, replicate, retrieval, summaries
from accord.plans import fragments as S
from accord.plans.fragments import WITH_EVENTS, WITH_SIGNATURES, truth_sql
from accord.plans.joins import EDGES, doses
from accord.plans.metrics import KEYS, LOO, _pair_record, rank_correlation
from accord.plans.registry import query, r, rounded
from accord.sources.views import event_samples, read, signatures

SCORES = {
    "cosine": (S.cosine("q.lfc", "d.lfc"), ">"),
    "pearson": (S.cosine("q.cx", "d.cx"), ">"),
    "spearman": (S.cosine("q.rx", "d.rx"), ">"),
    "mrrmse": (f"{S.l2('q.lfc', 'd.lfc')} / sqrt(64)", "<"),
}


def rank_sql(metric: str, scope: str = "true") -> str:
    """Ranks with scores of one expression on both sides; scores within 1e-12 of the match's count as equal to it."""
    score, better = SCORES[metric]
    margin = "gt + 1e-12" if better == ">" else "gt - 1e-12"
    return f"""{WITH_SIGNATURES}, samples AS (SELECT * EXCLUDE (lfc, t, p) FROM signatures), {truth_sql('samples')},
prepared AS (SELECT *, {S.centered('lfc')} AS cx, {S.centered('rk')} AS rx FROM (SELECT *, {S.ranks('lfc')} AS rk FROM signatures)),
scores AS (SELECT t.q_dataset, t.q_row_pos, t.db_dataset, t.db_row_pos AS gt_row, t.cell_type, t.cid, d.row_pos, {score} AS s FROM truth t JOIN prepared q ON q.row_pos = t.q_row_pos JOIN prepared d ON d.dataset = t.db_dataset AND {scope}),
gts AS (SELECT q_row_pos, db_dataset, s AS gt FROM scores WHERE row_pos = gt_row),
counts AS (SELECT q_dataset, q_row_pos AS q_row, db_dataset, gt_row, cell_type, cid, gt, count(s) AS n_candidates, count(*) FILTER (s {better} {margin} AND row_pos <> gt_row) + 1 AS rank FROM scores JOIN gts USING (q_row_pos, db_dataset) WHERE gt IS NOT NULL GROUP BY ALL),
detail AS (SELECT *, rank / CAST(n_candidates AS DOUBLE) AS rank_over_n, CASE WHEN n_candidates <= 1 THEN 0.0 ELSE (rank - 1) / CAST(n_candidates - 1 AS DOUBLE) END AS rank_normalized FROM counts)"""


DETAIL = f"q_dataset, db_dataset, cell_type, cid, q_row, gt_row, {r('gt', 'gt_score')}, n_candidates, rank, {r('rank_over_n', 'rank_over_n')}, {r('rank_normalized', 'rank_normalized')}, {r('1 - rank_normalized', 'retrieval_score')}"


def _detail(metric: str, scope: str = "all", layer: str = "lfc"):
    def f(s, d):
        out = retrieval.retrieval_detail(signatures(s, d), layer, metric, scope)
        return rounded(out.drop("representation", "metric"), "gt_score", "rank_over_n", "rank_normalized", "retrieval_score")

    return f


for _m in SCORES:
    query(f"rnk1_{_m}_rank", f"{rank_sql(_m)} SELECT {DETAIL} FROM detail")(_detail(_m))
query("rnk1_same_cell_type_rank", f"{rank_sql('cosine', 'd.cell_type = t.cell_type')} SELECT {DETAIL} FROM detail")(_detail("cosine", "same_cell_type"))


def _detail_frame(s, d):
    return retrieval.retrieval_detail(signatures(s, d), "lfc", "cosine")


AGG1 = f"count(*) AS n_queries, {r('avg(n_candidates)', 'mean_candidates')}, {r('median(n_candidates)', 'median_candidates')}, {r('avg(rank)', 'mean_rank')}, {r('median(rank)', 'median_rank')}, {r('avg(rank_over_n)', 'mean_rank_over_n')}, {r('avg(rank_normalized)', 'mean_rank_normalized')}, {r('avg(1 - rank_normalized)', 'mean_score')}, {r('median(1 - rank_normalized)', 'median_score')}"
AGG1_ROUNDED = ["mean_candidates", "median_candidates", "mean_rank", "median_rank", "mean_rank_over_n", "mean_rank_normalized", "mean_score", "median_score"]


@query("agg1_by_cell_type", f"{rank_sql('cosine')} SELECT q_dataset, db_dataset, cell_type, {AGG1} FROM detail GROUP BY ALL")
def _(s, d):
    return rounded(summaries.summarize_retrieval(_detail_frame(s, d), ["q_dataset", "db_dataset", "cell_type"]), *AGG1_ROUNDED)


@query("agg1_overall", f"{rank_sql('cosine')} SELECT q_dataset, db_dataset, {AGG1} FROM detail GROUP BY ALL")
def _(s, d):
    return rounded(summaries.summarize_retrieval(_detail_frame(s, d), ["q_dataset", "db_dataset"]), *AGG1_ROUNDED)


@query("agg18_dataset_scores", f"{rank_sql('cosine')}, m AS (SELECT q_dataset, db_dataset, avg(1 - rank_normalized) AS x FROM detail GROUP BY ALL), q AS (SELECT q_dataset AS dataset, avg(x) AS q FROM m GROUP BY ALL), b AS (SELECT db_dataset AS dataset, avg(x) AS b FROM m GROUP BY ALL) SELECT dataset, {r('q', 'as_query')}, {r('b', 'as_database')}, {r('(q + b) / 2', 'score')} FROM q FULL JOIN b USING (dataset)")
def _(s, d):
    m = _detail_frame(s, d).groupBy("q_dataset", "db_dataset").agg(F.avg("retrieval_score").alias("x"))
    q = m.groupBy(F.col("q_dataset").alias("dataset")).agg(F.avg("x").alias("as_query"))
    b = m.groupBy(F.col("db_dataset").alias("dataset")).agg(F.avg("x").alias("as_database"))
    return rounded(q.join(b, "dataset", "outer").withColumn("score", (F.col("as_query") + F.col("as_database")) / 2), "as_query", "as_database", "score")


# ---------------------------------------------------------------- positives and pool metrics

#: Queries of ds_a against the pool of ds_b in the same cell type and time, scored by cosine; positives share the compound.
POOL = f"""{WITH_SIGNATURES}, pool AS (SELECT q.row_pos AS query_id, d.row_pos AS candidate_id, q.cell_type, q.time_h, q.cid, {S.cosine('q.lfc', 'd.lfc')} AS score, q.cid = d.cid AS is_positive, q.dose_um AS qd, d.dose_um AS dd FROM signatures q JOIN signatures d ON q.dataset = 'ds_a' AND d.dataset = 'ds_b' AND q.cell_type = d.cell_type AND q.time_h = d.time_h)"""
BEST = "best AS (SELECT query_id, count(*) AS n_pool, CAST(sum(is_positive::INT) AS BIGINT) AS n_positive, min(rk) FILTER (is_positive) AS best_rank FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rk FROM pool) GROUP BY ALL)"
AUC = "auc AS (SELECT p.query_id, sum(CASE WHEN p.score > n.score THEN 1.0 ELSE 0.0 END + CASE WHEN abs(p.score - n.score) <= 1e-12 THEN 0.5 ELSE 0.0 END) / count(*) AS auroc FROM pool p JOIN pool n ON p.query_id = n.query_id AND p.is_positive AND NOT n.is_positive GROUP BY ALL)"


def pool(s, d):
    sig = signatures(s, d).select("row_pos", "dataset", "cell_type", "time_h", "cid", "dose_um", "lfc")
    q = matching.renamed(sig.filter("dataset = 'ds_a'"), "q_", ("cell_type", "time_h"))
    c = matching.renamed(sig.filter("dataset = 'ds_b'"), "d_", ("cell_type", "time_h"))
    return q.join(c, ["cell_type", "time_h"]).select(F.col("q_row_pos").alias("query_id"), F.col("d_row_pos").alias("candidate_id"), "cell_type", "time_h", F.col("q_cid").alias("cid"), V.cosine(F.col("q_lfc"), F.col("d_lfc")).alias("score"), (F.col("q_cid") == F.col("d_cid")).alias("is_positive"), F.col("q_dose_um").alias("qd"), F.col("d_dose_um").alias("dd"))


def pool_sides(s, d):
    """Queries and candidates of pool(); vectors are made double where they are scored."""
    sig = signatures(s, d, wide=False).select("row_pos", "dataset", "cell_type", "time_h", "cid", F.col("lfc").alias("vec"))
    return sig.filter("dataset = 'ds_a'").withColumnRenamed("row_pos", "query_id").drop("dataset"), sig.filter("dataset = 'ds_b'").withColumnRenamed("row_pos", "candidate_id").drop("dataset")


def records(s, d):
    return retrieval.pool_records(*pool_sides(s, d), ("cell_type", "time_h"))


@query("rnk3_best_positive_rank", f"{POOL}, {BEST} SELECT query_id, n_pool, n_positive, best_rank, {r('CASE WHEN n_pool >= 2 THEN 1 - (best_rank - 1) / CAST(n_pool - 1 AS DOUBLE) END', 'normalized_rank')} FROM best")
def _(s, d):
    return rounded(records(s, d).select("query_id", "n_pool", "n_positive", "best_rank", "normalized_rank"), "normalized_rank")


@query("rnk4_recall_at_1", f"{POOL}, {BEST} SELECT query_id, CASE WHEN best_rank IS NOT NULL THEN CAST(best_rank = 1 AS DOUBLE) END AS recall_at_1 FROM best")
def _(s, d):
    return records(s, d).select("query_id", "recall_at_1")


@query("rnk5_auroc", f"{POOL}, {AUC} SELECT query_id, {r('auroc', 'auroc')} FROM auc")
def _(s, d):
    return rounded(records(s, d).filter("auroc is not null").select("query_id", "auroc"), "auroc")


RNK6 = f"{POOL}, {BEST}, {AUC}, rec AS (SELECT query_id, n_pool, n_positive, CASE WHEN ok THEN 1 - (best_rank - 1) / CAST(n_pool - 1 AS DOUBLE) END AS normalized_rank, CASE WHEN ok THEN CAST(best_rank = 1 AS DOUBLE) END AS recall_at_1, CASE WHEN ok THEN auroc END AS auroc FROM (SELECT *, n_positive > 0 AND n_positive < n_pool AS ok FROM best) LEFT JOIN auc USING (query_id))"


@query("rnk6_retrieval_record", f"{RNK6} SELECT query_id, n_pool, n_positive, {r('normalized_rank', 'normalized_rank')}, recall_at_1, {r('auroc', 'auroc')} FROM rec")
def _(s, d):
    rec = retrieval.pool_summaries(records(s, d)).select("query_id", "n_pool", "n_positive", "normalized_rank", "recall_at_1", "auroc")
    return rounded(rec, "normalized_rank", "auroc")


@query("rnk7_dose_aware_positives", f"{POOL}, x AS (SELECT query_id, candidate_id, abs(log10(dd) - log10(qd)) AS diff, min(abs(log10(dd) - log10(qd))) OVER (PARTITION BY query_id) AS least FROM pool WHERE is_positive) SELECT query_id, candidate_id FROM x WHERE diff <= 1 + 1e-12 OR (least > 1 + 1e-12 AND abs(diff - least) <= 1e-12)")
def _(s, d):
    p = pool(s, d).filter("is_positive").select("query_id", "candidate_id", F.col("cid").alias("q_cid"), F.col("cid").alias("c_cid"), F.col("qd").alias("q_dose_um"), F.col("dd").alias("c_dose_um"))
    return pools.with_positives(p).filter("dose_aware").select("query_id", "candidate_id")


BASE = f"{LOO}, pool AS (SELECT q.row_pos AS query_id, q.cell_type, q.time_h, {S.cosine('q.lfc', 'd.lfc')} AS score, {S.cosine('q.lfc', 'base.b')} AS base FROM signatures q JOIN signatures d ON q.dataset = 'ds_a' AND d.dataset = 'ds_b' AND q.cell_type = d.cell_type AND q.time_h = d.time_h JOIN base ON base.dataset = q.dataset AND base.cell_type = q.cell_type AND base.time_h = q.time_h AND base.cid = q.cid)"


@query("rnk8_injected_baseline", f"{BASE} SELECT query_id, count(*) FILTER (score > base) + 1 AS rank, count(*) + 1 AS n_pool, {r('1 - count(*) FILTER (score > base) / CAST(count(*) AS DOUBLE)', 'normalized_rank')} FROM pool GROUP BY ALL")
def _(s, d):
    q, c = pool_sides(s, d)
    # A candidate is never above an undefined baseline; NaN is above all.
    mark = F.when(F.col("base").isNull() | F.isnan("base"), float("inf")).otherwise(F.col("base"))
    marks = q.select("cell_type", "time_h", "query_id").join(_own_base(s, d), "query_id").withColumn("marks", F.array(mark)).drop("base")
    counts = retrieval.pool_counts(q.join(marks.select("query_id"), "query_id", "left_semi"), c, ("cell_type", "time_h"), marks)
    rank, n = F.col("n_better") + 1, F.col("n_pool") + 1
    return rounded(counts.select("query_id", rank.alias("rank"), n.alias("n_pool"), (1 - (rank - 1) / (n - 1)).alias("normalized_rank")), "normalized_rank")


def _own_base(s, d):
    sig = signatures(s, d)
    base = baseline.baselines(sig, "lfc", KEYS).select(*KEYS, "cid", "baseline")
    return sig.filter("dataset = 'ds_a'").join(base, [*KEYS, "cid"]).select(F.col("row_pos").alias("query_id"), V.cosine(F.col("lfc"), F.col("baseline")).alias("base"))


def _with_base(s, d):
    return pool(s, d).join(_own_base(s, d), "query_id")


@query("bas3_in_pool_baseline", f"{BASE} SELECT query_id, {r('max(base)', 'base')} FROM pool GROUP BY ALL")
def _(s, d):
    return rounded(_with_base(s, d).groupBy("query_id").agg(F.max("base").alias("base")), "base")


@query("rnk9_random_reference", f"{POOL}, {BEST} SELECT query_id, {r('n_positive / CAST(n_pool AS DOUBLE)', 'recall_random')}, CAST(0.5 AS DOUBLE) AS rank_random, CAST(0.5 AS DOUBLE) AS auroc_random FROM best")
def _(s, d):
    b = records(s, d)
    return rounded(pools.random_reference(b).select("query_id", "recall_random", "rank_random", "auroc_random"), "recall_random")


CONTEXTS = f"""sides AS (SELECT dataset, cell_type, time_h, count(*) AS n, count(DISTINCT cid) AS k FROM signatures GROUP BY ALL),
contexts AS (SELECT a.cell_type, a.time_h, a.n AS n_left_conditions, a.k AS n_left_compounds, b.n AS n_right_conditions, b.k AS n_right_compounds, CASE WHEN least(a.n, b.n) < {pools.LEAST_ROWS} OR least(a.k, b.k) < {pools.LEAST_COMPOUNDS} THEN '{pools.TOO_FEW}' END AS reason FROM sides a JOIN sides b ON a.dataset = 'ds_a' AND b.dataset = 'ds_b' AND a.cell_type = b.cell_type AND a.time_h = b.time_h)"""


@query("rnk14_context_pools", f"{WITH_SIGNATURES}, {CONTEXTS} SELECT * FROM contexts")
def _(s, d):
    sig = signatures(s, d)
    return pools.context_pairs(sig.filter("dataset = 'ds_a'"), sig.filter("dataset = 'ds_b'"))


@query("rnk14_pool_vectors", f"{LOO} SELECT s.row_pos, CASE WHEN s.row_pos % 7 = 0 THEN 'missing: t' END AS error, {r('list_sum(s.lfc)', 'total')}, {r('list_sum(base.b)', 'base_total')} FROM signatures s LEFT JOIN base USING (dataset, cell_type, time_h, cid) WHERE s.dataset = 'ds_a'")
def _(s, d):
    sig = signatures(s, d)
    vectors = sig.select("row_pos", F.lit("lfc").alias("layer"), F.col("lfc").alias("vec")).unionByName(sig.filter("row_pos % 7 <> 0").select("row_pos", F.lit("t").alias("layer"), F.col("t").alias("vec")))
    pool = sig.filter("dataset = 'ds_a'").drop("lfc", "t", "p")
    got = pools.assembled(pool, vectors, ["lfc", "t"], {"lfc": baseline.baselines(sig, "lfc", KEYS)}, KEYS)
    return rounded(got.select("row_pos", "error", V.total(F.col("lfc")).alias("total"), V.total(F.col("lfc_baseline")).alias("base_total")), "total", "base_total")


@query("rnk7_positive_masks", f"""{WITH_SIGNATURES}, samples AS (SELECT * EXCLUDE (lfc, t, p) FROM signatures), {S.edges_sql('samples')}, {CONTEXTS},
pairs AS (SELECT q.row_pos AS query_id, d.row_pos AS candidate_id, q.cid = d.cid AS same, CASE WHEN q.cid = d.cid THEN abs(log10(d.dose_um) - log10(q.dose_um)) END AS diff FROM signatures q JOIN signatures d ON q.dataset = 'ds_a' AND d.dataset = 'ds_b' AND q.cell_type = d.cell_type AND q.time_h = d.time_h JOIN contexts c ON c.cell_type = q.cell_type AND c.time_h = q.time_h AND c.reason IS NULL),
least AS (SELECT *, min(diff) OVER (PARTITION BY query_id) AS m FROM pairs)
SELECT query_id, count(*) AS n_pool, CAST(count(*) FILTER (same) AS BIGINT) AS n_primary, CAST(count(*) FILTER (same AND (diff <= 1 + 1e-12 OR (m > 1 + 1e-12 AND abs(diff - m) <= 1e-12))) AS BIGINT) AS n_dose_aware,
CAST(count(*) FILTER (EXISTS (SELECT 1 FROM edges e WHERE e.a_row_pos = query_id AND e.b_row_pos = candidate_id)) AS BIGINT) AS n_strict FROM least GROUP BY query_id""")
def _(s, d):
    sig = signatures(s, d).drop("lfc", "t", "p")
    pairs = pools.candidate_pairs(sig.filter("dataset = 'ds_a'"), sig.filter("dataset = 'ds_b'"))
    marked = pools.with_positives(pairs, pools.strict_edges(matching.pair_edges(sig)))
    return marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pool"), *[F.count_if(F.col(c)).alias(f"n_{c}") for c in ("primary", "dose_aware", "strict")])


@query("agg2_nested_means", f"{RNK6}, j AS (SELECT rec.*, cell_type, time_h FROM rec JOIN (SELECT DISTINCT query_id, cell_type, time_h FROM pool) USING (query_id)), st AS (SELECT cell_type, time_h, avg(normalized_rank) AS x, count(*) AS n FROM j GROUP BY ALL), ln AS (SELECT cell_type, avg(x) AS x, sum(n) AS n FROM st GROUP BY ALL) SELECT 'all' AS level, CAST(sum(n) AS BIGINT) AS n, {r('avg(x)', 'normalized_rank')} FROM ln UNION ALL SELECT cell_type, CAST(n AS BIGINT), round(x, 6) + 0.0 FROM ln")
def _(s, d):
    rec = retrieval.pool_summaries(records(s, d))
    _, line, top = summaries.nested_means(rec, [["cell_type", "time_h"], ["cell_type"], []], ["normalized_rank"])
    out = line.select(F.col("cell_type").alias("level"), "n", "normalized_rank").unionByName(top.select(F.lit("all").alias("level"), "n", "normalized_rank"))
    return rounded(out, "normalized_rank")


# ---------------------------------------------------------------- replicates

CONDITION = ("dataset", "cell_type", "cid", "time_h")
CONDITION_SQL = ", ".join(CONDITION)
RING = f"""n AS (SELECT {CONDITION_SQL}, row_pos, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {CONDITION_SQL}) AS k FROM {{t}} WINDOW w AS (PARTITION BY {CONDITION_SQL} ORDER BY row_pos)),
ring AS (SELECT a.{', a.'.join(CONDITION)}, a.row_pos AS left_row, b.row_pos AS right_row, a.k AS n_replicates FROM n a JOIN n b ON a.dataset = b.dataset AND a.cell_type = b.cell_type AND a.cid = b.cid AND a.time_h = b.time_h AND b.i = (a.i + 1) % a.k WHERE a.k > 2 OR (a.k = 2 AND a.i = 0))"""


@query("rnk11_ring_pairs", f"{WITH_EVENTS}, {RING.replace('{t}', 'ev')} SELECT * FROM ring")
def _(s, d):
    return replicate.ring_pairs(event_samples(s, d), CONDITION)


@query("udtf_ring_pairs", "SELECT n_regionkey AS k, CAST(i AS INTEGER) AS \"left\", CAST((i + 1) % (n_regionkey + 1) AS INTEGER) AS \"right\" FROM (SELECT DISTINCT n_regionkey, unnest(range(0, n_regionkey + 1)) AS i FROM nation) WHERE n_regionkey + 1 > 2 OR (n_regionkey + 1 = 2 AND i = 0)")
def _(s, d):
    s.udtf.register("ring_pairs", replicate.RingPairs)
    n = read(s, d, "nation").select(F.col("n_regionkey").alias("k")).distinct()
    n.createOrReplaceTempView("accord_ring_sizes")
    return s.sql("SELECT k, p.left, p.right FROM accord_ring_sizes, LATERAL ring_pairs(CAST(k + 1 AS INT)) p")


@query("rnk10_replicate_retrieval", f"""{WITH_SIGNATURES}, {RING.replace('{t}', 'signatures')},
sc AS (SELECT DISTINCT l.dataset, l.cell_type, l.time_h, l.left_row AS query_id, l.cid AS qc, x.right_row AS candidate_id, x.cid AS cc FROM ring l JOIN ring x ON l.dataset = x.dataset AND l.cell_type = x.cell_type AND l.time_h = x.time_h WHERE l.left_row <> x.right_row),
s2 AS (SELECT sc.*, {S.cosine('q.lfc', 'd.lfc')} AS score FROM sc JOIN signatures q ON q.row_pos = query_id JOIN signatures d ON d.row_pos = candidate_id),
rk AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rr, count(*) OVER (PARTITION BY query_id) AS k FROM s2),
b AS (SELECT dataset, cell_type, time_h, qc AS cid, query_id, 1 - (min(rr) - 1) / CAST(max(k) - 1 AS DOUBLE) AS x FROM rk WHERE qc = cc AND k >= 2 GROUP BY ALL)
SELECT dataset, cell_type, cid, time_h, count(*) AS n_queries, {r('avg(x)', 'normalized_rank')} FROM b GROUP BY ALL""")
def _(s, d):
    sig = signatures(s, d)
    ring = replicate.ring_pairs(sig, CONDITION)
    place = ("dataset", "cell_type", "time_h")
    vec = sig.select("row_pos", F.col("lfc").alias("vec"))
    q = ring.select(*place, F.col("left_row").alias("row_pos"), "cid").distinct().join(vec, "row_pos").withColumnRenamed("row_pos", "query_id")
    c = ring.select(*place, F.col("right_row").alias("row_pos"), "cid").distinct().join(vec, "row_pos").withColumnRenamed("row_pos", "candidate_id")
    best = retrieval.pool_records(q, c, place, apart=True).filter("normalized_rank is not null")
    return rounded(best.groupBy("dataset", "cell_type", "cid", "time_h").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("normalized_rank").alias("normalized_rank")), "normalized_rank")


RECORD = f"{WITH_SIGNATURES}, {RING.replace('{t}', 'signatures')}, sc AS (SELECT ring.*, {rank_correlation('a.lfc', 'b.lfc')} AS lf, {rank_correlation('a.t', 'b.t')} AS tt, {S.cosine('a.lfc', 'b.lfc')} AS co FROM ring JOIN signatures a ON a.row_pos = left_row JOIN signatures b ON b.row_pos = right_row)"


def _scored_ring(s, d):
    sig = signatures(s, d)
    v = sig.select("row_pos", "lfc", "t")
    m = replicate.ring_pairs(sig, CONDITION).join(v.select(F.col("row_pos").alias("left_row"), F.col("lfc").alias("x"), F.col("t").alias("xt")), "left_row").join(v.select(F.col("row_pos").alias("right_row"), F.col("lfc").alias("y"), F.col("t").alias("yt")), "right_row")
    return m.select(*CONDITION, "left_row", "right_row", "n_replicates", V.spearman(F.col("x"), F.col("y")).alias("lfc"), V.spearman(F.col("xt"), F.col("yt")).alias("t"), V.cosine(F.col("x"), F.col("y")).alias("co"))


@query("vec10_vec11_replicate_spearman", f"{RECORD} SELECT left_row, right_row, {r('lf', 'lfc')}, {r('tt', 't')} FROM sc")
def _(s, d):
    return rounded(_scored_ring(s, d).select("left_row", "right_row", "lfc", "t"), "lfc", "t")


@query("agg9_condition_record", f"{RECORD} SELECT {CONDITION_SQL}, max(n_replicates) AS n_replicates, count(*) AS n_pairs, {r('avg(lf)', 'mean_lfc')}, {r('median(lf)', 'median_lfc')}, count(lf) AS n_lfc, {r('avg(tt)', 'mean_t')}, {r('median(tt)', 'median_t')}, count(tt) AS n_t FROM sc GROUP BY ALL")
def _(s, d):
    return rounded(replicate.condition_record(_scored_ring(s, d), ["lfc", "t"], CONDITION), "mean_lfc", "median_lfc", "mean_t", "median_t")


@query("agg10_dataset_record", f"{RECORD}, c AS (SELECT {CONDITION_SQL}, count(*) AS n, avg(lf) AS x FROM sc GROUP BY ALL) SELECT dataset, count(*) AS n_conditions, count(DISTINCT cid) AS n_compounds, CAST(sum(n) AS BIGINT) AS n_pairs, {r('avg(x)', 'mean_lfc')} FROM c GROUP BY ALL UNION ALL SELECT 'ds_none', 0, 0, 0, NULL")
def _(s, d):
    c = _scored_ring(s, d).groupBy(*CONDITION).agg(F.count(F.lit(1)).alias("n"), F.avg("lfc").alias("x"))
    out = c.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_conditions"), F.countDistinct("cid").alias("n_compounds"), F.sum("n").alias("n_pairs"), F.avg("x").alias("mean_lfc"))
    index = s.createDataFrame([("ds_a",), ("ds_b",), ("ds_c",), ("ds_none",)], "dataset string")
    return rounded(summaries.with_missing(out, index, ["dataset"], ["n_conditions", "n_compounds", "n_pairs"]), "mean_lfc")


@query("agg11_retrieval_summary", f"{RNK6}, j AS (SELECT rec.*, cell_type, time_h FROM rec JOIN (SELECT DISTINCT query_id, cell_type, time_h FROM pool) USING (query_id)), st AS (SELECT cell_type, time_h, avg(auroc) AS x FROM j GROUP BY ALL) SELECT cell_type, {r('avg(x)', 'auroc')} FROM st GROUP BY ALL")
def _(s, d):
    rec = retrieval.pool_summaries(records(s, d))
    line = summaries.nested_means(rec, [["cell_type", "time_h"], ["cell_type"]], ["auroc"])[1]
    return rounded(line.select("cell_type", "auroc"), "auroc")


@query("agg12_condition_retrieval_means", f"{RNK6}, j AS (SELECT rec.*, cell_type, cid FROM rec JOIN (SELECT DISTINCT query_id, cell_type, cid FROM pool) USING (query_id)) SELECT cell_type, cid, count(*) AS n, count(normalized_rank) AS n_defined, max(n_pool) AS largest_pool, {r('avg(normalized_rank)', 'normalized_rank')} FROM j GROUP BY ALL")
def _(s, d):
    rec = retrieval.pool_summaries(records(s, d))
    return rounded(rec.groupBy("cell_type", "cid").agg(F.count(F.lit(1)).alias("n"), F.count("normalized_rank").alias("n_defined"), F.max("n_pool").alias("largest_pool"), F.avg("normalized_rank").alias("normalized_rank")), "normalized_rank")


# ---------------------------------------------------------------- summaries


@query("agg3_signature_summary", f"{RECORD}, a AS (SELECT cell_type, cid, time_h, avg(lf) AS x, count(*) AS n FROM sc GROUP BY ALL) SELECT cell_type, CAST(sum(n) AS BIGINT) AS n, {r('avg(x)', 'lfc')} FROM a GROUP BY ALL")
def _(s, d):
    out = summaries.nested_means(_scored_ring(s, d), [["cell_type", "cid", "time_h"], ["cell_type"]], ["lfc"])[1]
    return rounded(out, "lfc")


@query("agg4_deg_summary", f"{RECORD}, a AS (SELECT dataset, cid, avg(lf) AS x, avg(tt) AS y, avg(co) AS z FROM sc GROUP BY ALL) SELECT dataset, {r('avg(x)', 'mean_lfc')}, {r('avg(y)', 'mean_t')}, {r('avg(z)', 'mean_co')} FROM a GROUP BY ALL")
def _(s, d):
    metrics = ["lfc", "t", "co"]
    out = summaries.nested_means(_scored_ring(s, d), [["dataset", "cid"], ["dataset"]], metrics)[1]
    return rounded(out.select("dataset", *[F.col(m).alias(f"mean_{m}") for m in metrics]), "mean_lfc", "mean_t", "mean_co")


DELTAS = f"{LOO}, samples AS (SELECT * EXCLUDE (lfc, t, p) FROM signatures), {S.edges_sql('samples')}, k AS (SELECT e.a_dataset, e.b_dataset, a.lfc AS x, b.lfc AS y, ba.b AS bx, bb.b AS byy FROM edges e JOIN signatures a ON a.row_pos = a_row_pos JOIN signatures b ON b.row_pos = b_row_pos LEFT JOIN base ba ON ba.dataset = e.a_dataset AND ba.cell_type = e.cell_type AND ba.time_h = e.time_h AND ba.cid = e.cid LEFT JOIN base bb ON bb.dataset = e.b_dataset AND bb.cell_type = e.cell_type AND bb.time_h = e.time_h AND bb.cid = e.cid), q AS (SELECT a_dataset, b_dataset, {rank_correlation('x', 'y')} AS o, CASE WHEN bx IS NOT NULL THEN {rank_correlation('x', 'bx')} END AS l, CASE WHEN byy IS NOT NULL THEN {rank_correlation('y', 'byy')} END AS rr FROM k), z AS (SELECT a_dataset, b_dataset, o - CASE WHEN l IS NOT NULL AND rr IS NOT NULL THEN (l + rr) / 2 ELSE coalesce(l, rr) END AS delta FROM q)"


@query("agg5_baseline_deltas", f"{DELTAS} SELECT a_dataset, b_dataset, count(delta) AS n, {r('avg(delta)', 'mean_delta')} FROM z GROUP BY ALL")
def _(s, d):
    return rounded(_pair_record(s, d).groupBy("a_dataset", "b_dataset").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean_delta")), "mean_delta")


@query("agg6_matched_counts", f"{EDGES} SELECT a_dataset, b_dataset, cell_type, count(*) AS n_pairs, count(DISTINCT cid) AS n_compounds, count(DISTINCT (cid, time_h)) AS n_conditions FROM edges GROUP BY ALL")
def _(s, d):
    return doses(s, d).groupBy("a_dataset", "b_dataset", "cell_type").agg(F.sum("n_pairs").alias("n_pairs"), F.countDistinct("cid").alias("n_compounds"), F.countDistinct("cid", "time_h").alias("n_conditions"))


@query("agg7_grouped_spearman", f"WITH k AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS y FROM lineitem) SELECT g AS l_returnflag, count(*) AS n_rows, {r('corr(x, y)', 'spearman')} FROM k GROUP BY ALL")
def _(s, d):
    return rounded(summaries.grouped_spearman(read(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount"), "spearman")


@query("agg8_strength_summary", f"{WITH_SIGNATURES} SELECT dataset, cell_type, cid, time_h, dose_um, {r('avg(list_sum(list_transform(t, lambda v: abs(v))) / 64)', 'strength')} FROM signatures GROUP BY ALL")
def _(s, d):
    return rounded(signatures(s, d).groupBy("dataset", "cell_type", "cid", "time_h", "dose_um").agg(F.avg(V.mean_abs(F.col("t"))).alias("strength")), "strength")


@query("agg13_inventory", f"{WITH_EVENTS} SELECT {CONDITION_SQL}, count(*) AS n_replicates, string_agg(DISTINCT src, '||' ORDER BY src) AS sources, min(obs_id) AS label, CAST(CASE WHEN count(*) < 2 THEN 0 WHEN count(*) = 2 THEN 1 ELSE count(*) END AS BIGINT) AS n_sampled_pairs, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_possible_pairs FROM (SELECT *, dataset || '/' || row_pos % 3 AS src FROM ev) GROUP BY {CONDITION_SQL}")
def _(s, d):
    e = event_samples(s, d).withColumn("source_path", F.concat_ws("/", "dataset", (F.col("row_pos") % 3).cast("string")))
    return replicate.inventory(e, CONDITION)


@query("agg14_dataset_summary", f"{WITH_EVENTS}, x AS (SELECT * FROM ev UNION ALL SELECT row_pos, obs_id, 'all', cell_type, cid, time_h, dose_um FROM ev) SELECT dataset, count(DISTINCT cid) AS n_compounds, count(DISTINCT cell_type) AS n_contexts, count(*) AS n_samples, string_agg(DISTINCT printf('%.2f', time_h), ',' ORDER BY printf('%.2f', time_h)) AS times, CAST(count(DISTINCT dose_um) AS BIGINT) AS n_doses FROM x GROUP BY ALL")
def _(s, d):
    e = event_samples(s, d)
    text = summaries.dataset_summary(e)
    return text.select("dataset", "n_compounds", "n_contexts", "n_samples", F.array_join(F.array_sort(F.split("times", ",")), ",").alias("times"), F.size(F.split("doses", ",")).cast("long").alias("n_doses"))


#: Events as samples of four kinds of system; every seventh is a control.
LABELLED = f"{WITH_EVENTS}, x AS (SELECT * REPLACE (CASE WHEN dataset = 'click' AND row_pos % 50 = 0 THEN 'CVCL_1' WHEN dataset = 'view' THEN cell_type ELSE 'CL_' || cell_type END AS cell_type), CASE WHEN dataset = 'error' THEN 'blood' WHEN row_pos % 3 = 0 THEN 'blood' ELSE 'liver' END AS tissue, row_pos % 7 = 0 AS control FROM ev)"
SYSTEM = "CASE WHEN bool_or(cell_type LIKE 'CVCL\\_%' ESCAPE '\\') THEN 'cell lines' WHEN bool_and(tissue = 'blood') THEN 'primary PBMC' WHEN bool_and(cell_type LIKE 'CL\\_%' ESCAPE '\\') THEN 'primary cells' ELSE 'cell lines' END"


def _labelled(s, d):
    e, at = event_samples(s, d), F.col("row_pos")
    context = F.when((F.col("dataset") == "click") & (at % 50 == 0), "CVCL_1").when(F.col("dataset") == "view", F.col("cell_type")).otherwise(F.concat(F.lit("CL_"), "cell_type"))
    tissue = F.when((F.col("dataset") == "error") | (at % 3 == 0), "blood").otherwise("liver")
    return e.withColumn("cell_type", context).withColumn("tissue", tissue).withColumn("is_control", (at % 7 == 0).cast("string")).withColumn("perturbagen", F.col("cid")).withColumn("assay", F.concat(F.lit("of "), "dataset"))


@query("agg14_system_labels", f"{LABELLED} SELECT dataset, {SYSTEM} AS system FROM x GROUP BY ALL")
def _(s, d):
    return _labelled(s, d).groupBy("dataset").agg(summaries.system_label(F.col("cell_type"), F.col("tissue")).alias("system"))


@query("agg14_inventory_summary", f"{LABELLED}, o AS (SELECT dataset AS dataset_name, {SYSTEM} AS system, 'of ' || dataset AS technology, count(DISTINCT cid) FILTER (NOT control) AS n_compounds, count(DISTINCT cell_type) AS n_contexts, count(*) AS n_samples, array_to_string(list_transform(list_sort(list(DISTINCT time_h)), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), '; ') AS timepoints_h, CASE dataset WHEN 'click' THEN 'https://example.org/click' ELSE 'NA' END AS source_url FROM x GROUP BY dataset) SELECT * FROM o UNION ALL SELECT 'all', (SELECT string_agg(DISTINCT system, '; ' ORDER BY system) FROM o), 'union across selected datasets', count(DISTINCT cid), count(DISTINCT cell_type), count(*), array_to_string(list_transform(list_sort(list(DISTINCT time_h)), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), '; '), 'NA' FROM x WHERE NOT control")
def _(s, d):
    return summaries.inventory_summary(_labelled(s, d), urls={"click": "https://example.org/click"}).drop("doses_uM")


@query("agg16_pairwise_matrix", f"{EDGES} SELECT name, CAST(sum(n) FILTER (other = 'click') AS BIGINT) AS click, CAST(sum(n) FILTER (other = 'view') AS BIGINT) AS view FROM (SELECT a_dataset AS name, b_dataset AS other, count(DISTINCT cid) AS n FROM edges GROUP BY ALL UNION ALL SELECT b_dataset, a_dataset, count(DISTINCT cid) FROM edges GROUP BY ALL) GROUP BY ALL")
def _(s, d):
    n = doses(s, d).groupBy("a_dataset", "b_dataset").agg(F.countDistinct("cid").alias("n"))
    return summaries.pair_matrix(n, "a_dataset", "b_dataset", "n", ["click", "view"])


@query("agg17_configuration_wins", f"WITH v AS (SELECT l_returnflag AS pair, l_linestatus || l_linenumber AS config, avg(l_quantity) AS x FROM lineitem GROUP BY ALL), w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY pair ORDER BY x DESC, config) = 1), n AS (SELECT config, count(*) AS k FROM w GROUP BY ALL) SELECT v.config, {r('avg(x)', 'mean_value')}, {r('median(x)', 'median_value')}, coalesce(max(k), 0) AS n_wins, {r('coalesce(max(k), 0) / CAST((SELECT count(*) FROM w) AS DOUBLE)', 'win_share')} FROM v LEFT JOIN n USING (config) GROUP BY v.config")
def _(s, d):
    v = read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("pair"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("config")).agg(F.avg("l_quantity").alias("x"))
    return rounded(summaries.winners(v, ["pair"], ["config"], "x"), "mean_value", "median_value", "win_share")


@query("agg19_test_selection", f"{WITH_EVENTS}, c AS (SELECT dataset, cell_type, count(*) AS n, count(DISTINCT cid) AS k FROM ev GROUP BY ALL) SELECT dataset, cell_type, n, k FROM c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, k DESC, cell_type) = 1")
def _(s, d):
    from accord.operators.tables import first_by

    c = event_samples(s, d).groupBy("dataset", "cell_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cid").alias("k"))
    return first_by(c, ["dataset"], F.desc("n"), F.desc("k"), "cell_type")


@query("agg20_violin_summary", f"SELECT l_returnflag, {r('avg(l_extendedprice)', 'mean_value', 3)}, {r('median(l_extendedprice)', 'median_value', 3)}, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY ALL")
def _(s, d):
    return rounded(read(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean_value"), F.median("l_extendedprice").alias("median_value"), F.countDistinct("l_partkey").alias("n_parts")), "mean_value", "median_value", digits=3)


@query("agg20_count_reconciliation", "WITH a AS (SELECT o_custkey AS k, count(*) AS expected FROM orders GROUP BY ALL), b AS (SELECT c_custkey AS k, 10 AS observed FROM customer) SELECT coalesce(a.k, b.k) AS k, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(expected, 0) <> coalesce(observed, 0)")
def _(s, d):
    a = read(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("expected"))
    b = read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(10).cast("long").alias("observed"))
    return datasets.count_mismatches(a, b, ["k"])


# ---------------------------------------------------------------- bootstrap


@query("agg22_nested_statistic", f"{WITH_EVENTS}, s AS (SELECT dataset, cell_type, time_h, sum(dose_um) / count(*) AS x FROM ev GROUP BY ALL), o AS (SELECT dataset, cell_type, avg(x) AS x FROM s GROUP BY ALL) SELECT dataset, {r('avg(x)', 'estimate')} FROM o GROUP BY ALL")
def _(s, d):
    sums = bootstrap.cluster_sums(event_samples(s, d), ["dataset"], "cid", ["time_h"], "dose_um", ["cell_type"])
    st = sums.groupBy("dataset", "outer", "stratum").agg((F.sum("total") / F.sum("n")).alias("x"))
    return rounded(st.groupBy("dataset", "outer").agg(F.avg("x").alias("x")).groupBy("dataset").agg(F.avg("x").alias("estimate")), "estimate")


@query("agg23_cluster_sums", f"{WITH_EVENTS} SELECT dataset, cid AS cluster, {r('sum(dose_um)', 'total', 3)}, count(*) AS n FROM ev GROUP BY ALL")
def _(s, d):
    sums = bootstrap.cluster_sums(event_samples(s, d), ["dataset"], "cid", [], "dose_um")
    return rounded(sums.select("dataset", "cluster", "total", "n"), "total", digits=3)


@query("agg24_bca_intervals")
def _(s, d):
    return bootstrap.bca_table(event_samples(s, d), ["dataset"], "cid", ["time_h"], ["dose_um"], ["cell_type"])


@query("agg24_interval_record", f"{WITH_EVENTS}, m AS (SELECT dataset, cell_type, time_h, sum(dose_um) / count(*) AS x FROM ev GROUP BY ALL), o AS (SELECT dataset, cell_type, avg(x) AS x FROM m GROUP BY ALL), e AS (SELECT dataset, avg(x) AS x FROM o GROUP BY ALL) SELECT dataset, 'dataset' AS summary_level, 'dose' AS metric, 'dose_um' AS value_col, {r('any_value(e.x)', 'mean')}, 0.95::DOUBLE AS ci_level, 200::BIGINT AS n_bootstrap_iterations, count(*) AS n_rows, count(dose_um) AS n_finite_rows, count(DISTINCT cid) AS n_compounds, 'cid' AS cluster_col, 'time_h' AS inner_strata, 'cell_type' AS outer_strata FROM ev JOIN e USING (dataset) GROUP BY dataset")
def _(s, d):
    t = bootstrap.interval_table(event_samples(s, d), ["dataset"], "cid", ["time_h"], {"dose": "dose_um"}, ["cell_type"], "dataset", resamples=200)
    return rounded(t.drop("ci_low", "ci_high", "ci_half_width", "ci_method", "ci_status", "n_bootstrap_valid", "uncertainty_scope"), "mean")


@query("agg25_half_width_ranges")
def _(s, d):
    t = bootstrap.interval_table(event_samples(s, d), ["dataset", "cell_type"], "cid", ["time_h"], {"dose": "dose_um"}, summary_level="context")
    return bootstrap.half_width_ranges(t)


@query("agg25_given_widths", f"{WITH_EVENTS}, w AS (SELECT dataset, time_h, (max(dose_um) - min(dose_um)) / 2 AS h, count(DISTINCT cid) AS n, CASE WHEN count(*) % 2 = 0 THEN 'bca' ELSE 'degenerate' END AS m FROM ev GROUP BY ALL) SELECT dataset, count(*) AS n_intervals, {r('min(h)', 'min_ci_half_width')}, {r('median(h)', 'median_ci_half_width')}, {r('max(h)', 'max_ci_half_width')}, min(n) AS min_n_compounds, max(n) AS max_n_compounds, string_agg(DISTINCT m, ',' ORDER BY m) AS ci_methods, 'ok' AS ci_statuses FROM w WHERE h IS NOT NULL GROUP BY ALL")
def _(s, d):
    w = event_samples(s, d).groupBy("dataset", "time_h").agg(((F.max("dose_um") - F.min("dose_um")) / 2).alias("ci_half_width"), F.countDistinct("cid").alias("n_compounds"), F.when(F.count(F.lit(1)) % 2 == 0, "bca").otherwise("degenerate").alias("ci_method"), F.lit("ok").alias("ci_status"))
    return rounded(bootstrap.half_width_ranges(w, ["dataset"]), "min_ci_half_width", "median_ci_half_width", "max_ci_half_width")
