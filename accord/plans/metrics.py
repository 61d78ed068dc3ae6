"""Vector metrics, retrieval, baselines, replicates, summaries and intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from accord.functions import blocks
from accord.functions import vectors as V
from accord.operators import baseline, matching, pairs
from accord.plans import fragments as S
from accord.plans.fragments import WITH_SIGNATURES, edges_sql
from accord.plans.registry import query, r, rounded
from accord.sources.views import signatures

PAIRS_SQL = f"""{WITH_SIGNATURES}, samples AS (SELECT * EXCLUDE (lfc, t, p) FROM signatures), {edges_sql('samples')},
v AS (SELECT e.*, a.lfc AS x, b.lfc AS y, a.t AS xt, b.t AS yt, a.p AS xp, b.p AS yp FROM edges e JOIN signatures a ON a.row_pos = a_row_pos JOIN signatures b ON b.row_pos = b_row_pos)"""


def matched(s, d, layers=("lfc", "t", "p")):
    sig = signatures(s, d)
    return pairs.pair_vectors(matching.pair_edges(sig.drop("lfc", "t", "p")), sig, list(layers))


def _pairwise(name: str, kernel, sql: str, layers=("lfc",)) -> None:
    @query(name, f"{PAIRS_SQL} SELECT a_row_pos, b_row_pos, {r(sql, 'score')} FROM v")
    def _(s, d):
        m = matched(s, d, layers)
        return rounded(m.select("a_row_pos", "b_row_pos", kernel().alias("score")), "score")


_pairwise("vec1_cosine", lambda: V.cosine(F.col("a_lfc"), F.col("b_lfc")), S.cosine("x", "y"))
_pairwise("vec2_rmse", lambda: V.rmse(F.col("a_lfc"), F.col("b_lfc")), f"{S.l2('x', 'y')} / sqrt(len(x))")
_pairwise("vec3_pearson", lambda: V.pearson(F.col("a_lfc"), F.col("b_lfc")), S.cosine("cx", "cy").join(["(SELECT ", f" FROM (SELECT {S.centered('x')} AS cx, {S.centered('y')} AS cy))"]))
RANK_CORRELATION = "(SELECT " + S.cosine("cx", "cy") + f" FROM (SELECT {S.centered('rx')} AS cx, {S.centered('ry')} AS cy FROM (SELECT {S.ranks('{0}')} AS rx, {S.ranks('{1}')} AS ry)))"


def rank_correlation(x: str, y: str) -> str:
    return RANK_CORRELATION.replace("{0}", x).replace("{1}", y)


_pairwise("vec9_spearman", lambda: V.spearman(F.col("a_lfc"), F.col("b_lfc")), rank_correlation("x", "y"))
_pairwise("vec5_spearman_t", lambda: V.spearman(F.col("a_t"), F.col("b_t")), rank_correlation("xt", "yt"), ("t",))
_pairwise("vec8_negative_l2", lambda: V.negative_l2(F.col("a_lfc"), F.col("b_lfc")), f"-{S.l2('x', 'y')}")
SIGNED = "list_transform(range(1, len({0}) + 1), lambda i: -log10(greatest({1}[i], 1e-300)) * sign({0}[i]))"
_pairwise("vec7_signed_significance", lambda: V.cosine(V.signed_significance(F.col("a_lfc"), F.col("a_p")), V.signed_significance(F.col("b_lfc"), F.col("b_p"))), f"(SELECT {S.cosine('sx', 'sy')} FROM (SELECT {SIGNED.replace('{0}', 'x').replace('{1}', 'xp')} AS sx, {SIGNED.replace('{0}', 'y').replace('{1}', 'yp')} AS sy))", ("lfc", "p"))


def _overlap_sql(k: int) -> str:
    same = lambda f: f"len(list_intersect({S.by_value('xt', f, str(k))}, {S.by_value('yt', f, str(k))}))"
    return f"({same(True)} + {same(False)}) / (2.0 * {k})"


_pairwise("vec12_signed_overlap", lambda: V.signed_overlap(F.col("a_t"), F.col("b_t"), 50, True), _overlap_sql(32), ("t",))
_pairwise("vec13_signed_overlap_whole", lambda: V.signed_overlap(F.col("a_t"), F.col("b_t"), 10, False), _overlap_sql(10), ("t",))


@query("vec4_centered_ranks", f"{WITH_SIGNATURES}, c AS (SELECT row_pos, {S.ranks('t')} AS rk FROM signatures) SELECT row_pos, {r('rk[1] - (len(rk) + 1) / 2.0', 'first')}, {r('sqrt(list_sum(list_transform(rk, lambda v: (v - 32.5) * (v - 32.5))))', 'norm')} FROM c")
def _(s, d):
    c = V.centered(V.ranks(F.col("t")))
    return rounded(signatures(s, d).select("row_pos", c[0].alias("first"), V.norm(c).alias("norm")), "first", "norm")


@query("vec6_signed_and_z", f"{WITH_SIGNATURES} SELECT row_pos, {r('list_sum(list_transform(range(1, 65), lambda i: -log10(least(greatest(p[i], 1e-300), 1 - 1e-16)) * sign(lfc[i])))', 'signed_sum', 2)} FROM signatures")
def _(s, d):
    return rounded(signatures(s, d).select("row_pos", V.total(V.signed_log_p(F.col("lfc"), F.col("p"))).alias("signed_sum")), "signed_sum", digits=2)


@query("vec6_z_scores")
def _(s, d):
    def run(batches):
        for x in batches:
            z = [blocks.signed_and_z(np.array(a), np.array(b))[1] for a, b in zip(x["lfc"], x["p"])]
            yield pd.DataFrame({"row_pos": x["row_pos"], "n_finite": [int(np.isfinite(v).sum()) for v in z], "z0": [float(v[0]) for v in z]})

    return signatures(s, d).select("row_pos", "lfc", "p").mapInPandas(run, "row_pos long, n_finite long, z0 double")


@query("vec14_signature_scores", f"{PAIRS_SQL} SELECT a_row_pos, b_row_pos, {r(rank_correlation('x', 'y'), 'spearman_lfc')}, {r(rank_correlation('xt', 'yt'), 'spearman_t')}, {r(_overlap_sql(32), 'overlap_t')}, {r('list_sum(list_transform(xt, lambda v: abs(v))) / len(xt)', 'a_mean_abs_t')}, {r('list_sum(list_transform(yt, lambda v: abs(v))) / len(yt)', 'b_mean_abs_t')} FROM v")
def _(s, d):
    scores = pairs.signature_scores()
    return rounded(matched(s, d, ("lfc", "t")).select("a_row_pos", "b_row_pos", *[c.alias(n) for n, c in scores.items()]), *scores)


MASKS = "m AS (SELECT *, list_transform(range(1, len(x) + 1), lambda i: xp[i] < 0.5 AND abs(x[i]) > 0.1) AS mx, list_transform(range(1, len(y) + 1), lambda i: yp[i] < 0.5 AND abs(y[i]) > 0.1) AS my FROM v)"
DEG_P, DEG_LFC = 0.5, 0.1


@query("vec15_deg_counts", f"{PAIRS_SQL}, {MASKS} SELECT a_row_pos, b_row_pos, CAST(len(list_filter(mx, lambda b: b)) AS BIGINT) AS n_deg_a, CAST(len(list_filter(my, lambda b: b)) AS BIGINT) AS n_deg_b FROM m")
def _(s, d):
    m = pairs.with_masks(matched(s, d, ("lfc", "p")), DEG_P, DEG_LFC)
    return m.select("a_row_pos", "b_row_pos", V.count_true(F.col("a_m")).cast("long").alias("n_deg_a"), V.count_true(F.col("b_m")).cast("long").alias("n_deg_b"))


@query("vec16_ranked_genes", f"{PAIRS_SQL}, {MASKS} SELECT a_row_pos, b_row_pos, array_to_string(list_transform({S.by_size('x', 'mx')}, lambda i: CAST(i - 1 AS VARCHAR)), ',') AS masked, array_to_string(list_transform({S.by_size('y')}[1:5], lambda i: CAST(i - 1 AS VARCHAR)), ',') AS top FROM m")
def _(s, d):
    m = pairs.with_masks(matched(s, d, ("lfc", "p")), DEG_P, DEG_LFC)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return m.select("a_row_pos", "b_row_pos", text(V.order_by_size(F.col("a_lfc"), F.col("a_m"))).alias("masked"), text(F.slice(V.order_by_size(F.col("b_lfc")), 1, 5)).alias("top"))


RANKED = f"rk AS (SELECT *, {S.by_size('x', 'mx')} AS ra, {S.by_size('y', 'my')} AS rb, {S.by_size('x')} AS fa, {S.by_size('y')} AS fb, len(list_filter(mx, lambda b: b)) AS na, len(list_filter(my, lambda b: b)) AS nb FROM m)"


@query("vec17_top_overlap", f"{PAIRS_SQL}, {MASKS}, {RANKED} SELECT a_row_pos, b_row_pos, {r(S.overlap('ra', 'rb', '10'), 'at_10')}, {r(S.overlap('ra', 'rb', '50'), 'at_50')} FROM rk")
def _(s, d):
    m = pairs.with_masks(matched(s, d, ("lfc", "p")), DEG_P, DEG_LFC)
    a, b = V.order_by_size(F.col("a_lfc"), F.col("a_m")), V.order_by_size(F.col("b_lfc"), F.col("b_m"))
    return rounded(m.select("a_row_pos", "b_row_pos", V.overlap_fraction(a, b, 10).alias("at_10"), V.overlap_fraction(a, b, 50).alias("at_50")), "at_10", "at_50")


BOTH = "list_filter(range(1, len(x) + 1), lambda i: mx[i] AND my[i])"
DIRECTION = f"CASE WHEN len({BOTH}) > 0 THEN len(list_filter({BOTH}, lambda i: sign(x[i]) = sign(y[i]))) / CAST(len({BOTH}) AS DOUBLE) END"


@query("vec18_direction_agreement", f"{PAIRS_SQL}, {MASKS} SELECT a_row_pos, b_row_pos, {r(DIRECTION, 'agreement')} FROM m")
def _(s, d):
    m = pairs.with_masks(matched(s, d, ("lfc", "p")), DEG_P, DEG_LFC)
    return rounded(m.select("a_row_pos", "b_row_pos", V.direction_agreement(F.col("a_lfc"), F.col("b_lfc"), F.col("a_m"), F.col("b_m")).alias("agreement")), "agreement")


LEFT_SPEARMAN = f"CASE WHEN len(list_filter(mx, lambda b: b)) >= 2 THEN {rank_correlation(S.masked('x', 'mx'), S.masked('y', 'mx'))} END"
RIGHT_SPEARMAN = f"CASE WHEN len(list_filter(my, lambda b: b)) >= 2 THEN {rank_correlation(S.masked('x', 'my'), S.masked('y', 'my'))} END"


@query("vec19_deg_spearman", f"{PAIRS_SQL}, {MASKS} SELECT a_row_pos, b_row_pos, {r(LEFT_SPEARMAN, 'left_score')}, {r(RIGHT_SPEARMAN, 'right_score')} FROM m")
def _(s, d):
    m = pairs.with_masks(matched(s, d, ("lfc", "p")), DEG_P, DEG_LFC)
    left = V.spearman(V.masked(F.col("a_lfc"), F.col("a_m")), V.masked(F.col("b_lfc"), F.col("a_m")))
    right = V.spearman(V.masked(F.col("a_lfc"), F.col("b_m")), V.masked(F.col("b_lfc"), F.col("b_m")))
    return rounded(m.select("a_row_pos", "b_row_pos", left.alias("left_score"), right.alias("right_score")), "left_score", "right_score")


@query("vec20_deg_pair_record", f"""{PAIRS_SQL}, {MASKS}, {RANKED}, q AS (SELECT *, {LEFT_SPEARMAN} AS l, {RIGHT_SPEARMAN} AS rr, {S.overlap('ra', 'fb', 'na')} AS ol, {S.overlap('rb', 'fa', 'nb')} AS orr, {DIRECTION} AS da FROM rk)
SELECT a_row_pos, b_row_pos, CAST(na AS BIGINT) AS n_deg_a, CAST(nb AS BIGINT) AS n_deg_b, {r('l', 'spearman_left')}, {r('rr', 'spearman_right')}, {r('(l + rr) / 2', 'spearman_symmetric')}, {r('ol', 'overlap_left')}, {r('orr', 'overlap_right')}, {r('(ol + orr) / 2', 'overlap_symmetric')}, {r('da', 'direction_agreement')}, {r(S.overlap('ra', 'rb', '20'), 'overlap_at_20')} FROM q""")
def _(s, d):
    out = pairs.deg_records(matching.edges_by_dose(signatures(s, d), ("row_pos", "lfc", "p")), (20,), DEG_P, DEG_LFC)
    return rounded(out, *[n for n in out.columns if "spearman" in n or "overlap" in n or "direction" in n])


@query("vec22_pair_cells", f"{PAIRS_SQL} SELECT a_dataset, b_dataset, count(*) AS n, {r('avg(' + S.dot('x', 'y') + ')', 'mean_dot')} FROM v GROUP BY ALL")
def _(s, d):
    m = matched(s, d, ("lfc",))
    return rounded(m.groupBy("a_dataset", "b_dataset").agg(F.count(F.lit(1)).alias("n"), F.avg(V.dot(F.col("a_lfc"), F.col("b_lfc"))).alias("mean_dot")), "mean_dot")


@query("vec23_mean_abs_t", f"{WITH_SIGNATURES} SELECT row_pos, {r('list_sum(list_transform(t, lambda v: abs(v))) / len(t)', 'strength')} FROM signatures")
def _(s, d):
    return rounded(signatures(s, d).select("row_pos", V.mean_abs(F.col("t")).alias("strength")), "strength")


# ---------------------------------------------------------------- baselines

STRATUM = "dataset, cell_type, time_h"
CELLS = f"cells AS (SELECT {STRATUM}, cid, unnest(range(0, 64)) AS i, unnest(lfc) AS v FROM signatures)"
LOO = f"""{WITH_SIGNATURES}, {CELLS}, own AS (SELECT {STRATUM}, cid, i, sum(v) AS s, count(*) AS n FROM cells GROUP BY ALL),
loo AS (SELECT {STRATUM}, cid, i, sum(s) OVER w - s AS ls, sum(n) OVER w - n AS ln FROM own WINDOW w AS (PARTITION BY {STRATUM}, i)),
base AS (SELECT {STRATUM}, cid, CAST(max(ln) AS BIGINT) AS n_peers, list(ls / ln ORDER BY i) AS b FROM loo WHERE ln > 0 GROUP BY ALL)"""
KEYS = ("dataset", "cell_type", "time_h")


@query("bas1_strict_baseline", f"{LOO} SELECT {STRATUM}, cid, n_peers, {r('list_sum(b)', 'total')}, {r('b[1]', 'first')} FROM base")
def _(s, d):
    b = baseline.baselines(signatures(s, d), "lfc", KEYS, "strict")
    return rounded(b.select(*KEYS, "cid", "n_peers", V.total(F.col("baseline")).alias("total"), F.col("baseline")[0].alias("first")), "total", "first")


@query("bas2_finite_baseline", f"{WITH_SIGNATURES}, c AS (SELECT {STRATUM}, cid, unnest(range(0, 64)) AS i, unnest(list_transform(lfc, lambda v, k: CASE WHEN row_pos % 5 = 0 AND k < 9 THEN NULL ELSE v END)) AS v FROM signatures), own AS (SELECT {STRATUM}, cid, i, coalesce(sum(v), 0) AS s, count(v) AS n FROM c GROUP BY ALL), loo AS (SELECT {STRATUM}, cid, i, sum(s) OVER w - s AS ls, sum(n) OVER w - n AS ln FROM own WINDOW w AS (PARTITION BY {STRATUM}, i)) SELECT {STRATUM}, cid, {r('sum(CASE WHEN ln > 0 THEN ls / ln END)', 'total')} FROM loo GROUP BY ALL HAVING max(ln) > 0")
def _(s, d):
    hole = lambda v, k: F.when((F.col("row_pos") % 5 == 0) & (k < 8), F.lit(None).cast("double")).otherwise(v)
    b = baseline.baselines(signatures(s, d).withColumn("lfc", F.transform("lfc", hole)), "lfc", KEYS)
    return rounded(b.select(*KEYS, "cid", V.total(F.filter("baseline", lambda v: v.isNotNull())).alias("total")), "total")


@query("vec21_baseline_deg", f"{LOO}, k AS (SELECT s.row_pos, s.lfc AS x, base.b AS y, list_transform(range(1, 65), lambda i: s.p[i] < 0.5 AND abs(s.lfc[i]) > 0.1) AS mx FROM signatures s JOIN base USING ({STRATUM}, cid)) SELECT row_pos, {r(LEFT_SPEARMAN, 'base_spearman')}, {r(S.overlap(S.by_size('x', 'mx'), S.by_size('y'), 'len(list_filter(mx, lambda b: b))'), 'base_overlap')}, {r('CASE WHEN len(list_filter(mx, lambda b: b)) > 0 THEN len(list_filter(range(1, 65), lambda i: mx[i] AND sign(x[i]) = sign(y[i]))) / CAST(len(list_filter(mx, lambda b: b)) AS DOUBLE) END', 'base_direction')} FROM k")
def _(s, d):
    sig = signatures(s, d)
    base = baseline.baselines(sig, "lfc", KEYS).select(*KEYS, "cid", F.col("baseline").alias("base"))
    m = sig.join(base, [*KEYS, "cid"]).select("row_pos", F.col("lfc").alias("a_lfc"), "base", V.deg_mask(F.col("lfc"), F.col("p"), DEG_P, DEG_LFC).alias("a_m"))
    scores = pairs.baseline_deg_scores()
    return rounded(m.select("row_pos", *[c.alias(n) for n, c in scores.items()]), *scores)


@query("vec24_pair_record", f"{LOO}, samples AS (SELECT * EXCLUDE (lfc, t, p) FROM signatures), {edges_sql('samples')}, k AS (SELECT e.a_row_pos, e.b_row_pos, a.lfc AS x, b.lfc AS y, ba.b AS bx, bb.b AS byy FROM edges e JOIN signatures a ON a.row_pos = a_row_pos JOIN signatures b ON b.row_pos = b_row_pos LEFT JOIN base ba ON ba.dataset = e.a_dataset AND ba.cell_type = e.cell_type AND ba.time_h = e.time_h AND ba.cid = e.cid LEFT JOIN base bb ON bb.dataset = e.b_dataset AND bb.cell_type = e.cell_type AND bb.time_h = e.time_h AND bb.cid = e.cid), q AS (SELECT a_row_pos, b_row_pos, {rank_correlation('x', 'y')} AS o, CASE WHEN bx IS NOT NULL THEN {rank_correlation('x', 'bx')} END AS l, CASE WHEN byy IS NOT NULL THEN {rank_correlation('y', 'byy')} END AS rr FROM k) SELECT a_row_pos, b_row_pos, {r('o', 'observed')}, {r('l', 'a_baseline')}, {r('rr', 'b_baseline')}, {r('CASE WHEN l IS NOT NULL AND rr IS NOT NULL THEN (l + rr) / 2 ELSE coalesce(l, rr) END', 'baseline')}, {r('o - CASE WHEN l IS NOT NULL AND rr IS NOT NULL THEN (l + rr) / 2 ELSE coalesce(l, rr) END', 'delta')} FROM q")
def _(s, d):
    return rounded(_pair_record(s, d).select("a_row_pos", "b_row_pos", "observed", "a_baseline", "b_baseline", "baseline", "delta"), "observed", "a_baseline", "b_baseline", "baseline", "delta")


def _pair_record(s, d):
    sig = signatures(s, d)
    base = baseline.baselines(sig, "lfc", KEYS)
    m = matched(s, d, ("lfc",)).withColumn("a_cell_type", F.col("cell_type")).withColumn("b_cell_type", F.col("cell_type")).withColumn("a_time_h", F.col("time_h")).withColumn("b_time_h", F.col("time_h"))
    out = pairs.baseline_scores(m, base, "lfc", list(KEYS)).withColumn("observed", V.spearman(F.col("a_lfc"), F.col("b_lfc")))
    return out.withColumn("delta", F.col("observed") - F.col("baseline"))


@query("bas4_replicate_baseline", f"{LOO}, samples AS (SELECT * EXCLUDE (lfc, t, p) FROM signatures), k AS (SELECT s.row_pos, s.dataset, {S.cosine('s.lfc', 'base.b')} AS c FROM signatures s JOIN base USING ({STRATUM}, cid)) SELECT a.row_pos AS left_row, b.row_pos AS right_row, {r('(a.c + b.c) / 2', 'baseline')} FROM k a JOIN k b ON b.row_pos = a.row_pos + 3")
def _(s, d):
    sig = signatures(s, d)
    base = baseline.baselines(sig, "lfc", KEYS)
    own = sig.join(base, [*KEYS, "cid"]).select("row_pos", V.cosine(F.col("lfc"), F.col("baseline")).alias("c"))
    p = own.select(F.col("row_pos").alias("left_row"), F.col("c").alias("l")).join(own.select((F.col("row_pos") - 3).alias("left_row"), F.col("row_pos").alias("right_row"), F.col("c").alias("r")), "left_row")
    from accord.functions.keys import mean_available

    return rounded(p.select("left_row", "right_row", mean_available(F.col("l"), F.col("r")).alias("baseline")), "baseline")
