"""Kernels against plain numpy, rules of matching, baselines, ranks, intervals, files and workflows."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from accord import cli
from accord.functions import blocks, keys
from accord.functions import vectors as V
from accord.operators import baseline, bootstrap, graph, matching, pairs, replicate, retrieval, summaries, tables, universe
from accord.plans import workflows
from accord.sources import files
from accord.streaming import incremental


def rank(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def pearson(x, y):
    x, y = x - x.mean(), y - y.mean()
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return None if np.linalg.norm(x) <= 1e-12 or n <= 1e-12 else float(x @ y / n)


VECTORS = [([1.0, 2.0, 3.0], [2.0, 4.0, 7.0]), ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0]), ([1.0, 1.0, 2.0], [3.0, 3.0, 1.0]), ([5.0, 5.0, 5.0], [1.0, 2.0, 3.0]), ([1e-13, 0.0, 0.0], [1.0, 0.0, 0.0]), ([-1.0, 0.5, 2.5], [1.5, -2.0, 0.25])]


def test_native_kernels(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(VECTORS)], "i int, x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    got = df.select("i", V.cosine(x, y).alias("c"), V.pearson(x, y).alias("p"), V.spearman(x, y).alias("s"), V.rmse(x, y).alias("r"), V.negative_l2(x, y).alias("l")).orderBy("i").collect()
    for g, (a, b) in zip(got, VECTORS):
        a, b = np.array(a), np.array(b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        want = [float(a @ b / n) if np.linalg.norm(a) > 1e-12 and n > 1e-12 else None, pearson(a, b), pearson(rank(a), rank(b)), float(np.sqrt(((a - b) ** 2).mean())), -float(np.linalg.norm(a - b))]
        for have, need in zip(g[1:], want):
            assert (have is None) == (need is None) and (need is None or math.isclose(have, need, abs_tol=1e-12))


@pytest.mark.parametrize("metric", blocks.METRICS)
def test_block_kernels_match_single_pairs(metric):
    r = np.random.default_rng(1)
    q, d = r.normal(size=(9, 12)), r.normal(size=(17, 12)).round(1)
    q[3] = 0
    q[4, 2] = np.nan
    d[5] = 7
    s = blocks.scores(blocks.prepared(q, metric), blocks.prepared(d, metric), metric)
    for i in range(9):
        for j in range(17):
            a, b = q[i], d[j]
            if not np.isfinite(a).all():
                want = None
            elif metric == "mrrmse":
                want = float(np.sqrt(((a - b) ** 2).mean()))
            elif metric == "negative_l2":
                want = -float(np.linalg.norm(a - b))
            elif metric == "cosine":
                want = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if np.linalg.norm(a) > 1e-12 else None
            else:
                want = pearson(a, b) if metric == "pearson" else pearson(rank(a), rank(b))
            assert np.isnan(s[i, j]) if want is None else math.isclose(s[i, j], want, abs_tol=1e-7)


def test_signed_and_z():
    signed, z = blocks.signed_and_z(np.array([1.0, -2.0, 0.0, 1.0]), np.array([0.05, 0.01, 0.5, 0.0]))
    assert np.allclose(signed[:3], [-math.log10(0.05), math.log10(0.01), 0]) and signed[3] == 300
    assert np.allclose(z[:2], [NormalDist().inv_cdf(0.975), -NormalDist().inv_cdf(0.995)]) and np.isinf(z[3])
    assert np.isnan(blocks.signed_and_z(np.array([0.0]), np.array([0.0]))[1][0])


def test_deg_masks_compare_in_double(spark):
    df = spark.createDataFrame([([0.2, 0.2, 0.3], [0.01, 0.05, 0.001])], "e array<float>, p array<float>")
    mask = df.select(V.deg_mask(V.doubles(F.col("e")), V.doubles(F.col("p")))).first()[0]
    assert mask == [True, False, True]  # a stored 0.2 widens above 0.2, a stored 0.05 above 0.05


def test_overlaps(spark):
    df = spark.createDataFrame([([3.0, -1.0, 2.0, 0.5], [3.0, -1.0, 2.0, 0.5])], "x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    row = df.select(V.signed_overlap(x, y, 50, True), V.signed_overlap(x, y, 50, False), V.overlap_fraction(V.order_by_size(x), V.order_by_size(y), 5), V.order_by_size(F.array(*map(F.lit, [1.0, -1.0, 0.5])))).first()
    assert row[0] == row[1] == 1.0 and row[2] is None and row[3] == [0, 1, 2]


def test_keys(spark):
    rows = [("123",), ("123.0",), ("abc",), (" NaN ",), (None,), ("1d",), ("12.5",), ("1e3",)]
    df = spark.createDataFrame(rows, "c string")
    assert [r[0] for r in df.select(keys.compound_id(F.col("c"))).collect()] == ["123", "123", "abc", "", "", "1d", "12.5", "1000"]
    assert [r[0] for r in df.select(keys.number(F.col("c"))).collect()] == [123, 123, None, None, None, None, 12.5, 1000]
    nums = spark.createDataFrame([(24.0,), (24.0001,), (100000.4,), (1e-9,), (0.123456789012345,), (None,)], "v double")
    got = nums.select(keys.number_key(F.col("v")), keys.number_key(F.col("v"), "inventory"), keys.number_key(F.col("v"), "replicate")).collect()
    assert [tuple(r) for r in got] == [("24", "24", "24"), ("24.0001", "24.0001", "24"), ("100000.4", "100000", "100000"), ("1e-09", "1e-09", "0"), ("0.123456789012", "0.123457", "0.123456789012"), (None, None, None)]


NEAREST = [((24, 1), [(6, 1), (24, 100)], 1), ((24, 1), [(24, 0.1), (24, 5)], 1), ((12, 1), [(6, 1), (18, 1)], 0), ((24, 0), [(24, 0.1), (24, 5)], 0), ((24, 1), [(24, 0), (24, 10)], 0)]


@pytest.mark.parametrize("query, candidates, want", NEAREST)
def test_nearest_rules(spark, query, candidates, want):
    schema = "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double"
    q = spark.createDataFrame([(0, "a", "ct", "1", float(query[0]), float(query[1]))], schema)
    d = spark.createDataFrame([(i, "b", "ct", "1", float(t), float(x)) for i, (t, x) in enumerate(candidates)], schema)
    assert matching.nearest_match(q, d).first()["db_row_pos"] == want


@pytest.mark.parametrize("left, right, want", [([0], [-1, 1], [(0, -1), (0, 1)]), ([0, 1], [0.4], [(0, 0.4)]), ([0], [1.5], []), ([], [0], [])])
def test_mutual_nearest_rules(spark, left, right, want):
    schema = "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double"
    rows = lambda xs, n: [(i, n, "ct", "1", 24.0, 10.0**x) for i, x in enumerate(xs)]
    got = matching.mutual_nearest(spark.createDataFrame(rows(left, "a"), schema), spark.createDataFrame(rows(right, "b"), schema)).collect()
    assert sorted((left[r.a_row_pos], right[r.b_row_pos]) for r in got) == sorted(want)


def test_components(spark):
    e = spark.createDataFrame([("a", "1", "b", "1"), ("b", "1", "c", "1"), ("a", "2", "b", "3")], "a_dataset string, a_obs_id string, b_dataset string, b_obs_id string")
    table = graph.component_table(graph.component_members(e)).orderBy("component_id").collect()
    assert [(r.component_id, r.n_datasets, r.members) for r in table] == [("component_00001", 2, "a::2,b::3"), ("component_00002", 3, "a::1,b::1,c::1")]


def test_gene_axis_first_duplicate(spark):
    f = spark.createDataFrame([("s", 1, "A"), ("s", 2, " "), ("s", 4, "A "), ("s", 5, "B"), ("t", 0, "B"), ("t", 3, None)], "source_path string, gene_pos int, symbol string")
    axis = universe.gene_axis(f)
    assert sorted((r.source_path, r.gene_key, r.gene_pos) for r in axis.collect()) == [("s", "A", 1), ("s", "B", 5), ("t", "B", 0)]
    assert universe.pair_alignment(axis).first()["idx_a"] == [5]


@pytest.mark.parametrize("mode", ["finite", "strict"])
def test_leave_one_out_is_the_direct_mean(spark, mode):
    r = np.random.default_rng(0)
    rows = []
    for i in range(40):
        v = r.normal(size=5)
        if i % 6 == 0:
            v[i % 5] = np.nan
        rows.append((i, "d", f"ct{i % 2}", f"c{i % 4}", 24.0, 1.0, [float(x) for x in v]))
    sig = spark.createDataFrame(rows, "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double, lfc array<double>")
    got = {(x.cell_type, x.cid): x for x in baseline.baselines(sig, "lfc", mode=mode).collect()}
    for (ct, cid), g in got.items():
        peers = np.array([x[6] for x in rows if x[2] == ct and x[3] != cid])
        want = np.nanmean(peers, 0) if mode == "finite" else peers.mean(0)
        assert g.n_peers == len(peers)
        for have, need in zip(g.baseline, want):
            assert have is None if np.isnan(need) else math.isclose(have, need, abs_tol=1e-12)


def test_self_retrieval_ranks_first(spark):
    r = np.random.default_rng(2)
    rows = [(i, "d", "ct", str(i), 24.0, 1.0, [float(x) for x in r.normal(size=8)]) for i in range(50)]
    sig = spark.createDataFrame(rows, "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double, lfc array<double>")
    for metric in ("cosine", "mrrmse", "spearman"):
        got = retrieval.retrieval_detail(sig, "lfc", metric, include_self=True).collect()
        assert len(got) == 50 and all(g["rank"] == 1 and g.n_candidates == 50 and g.retrieval_score == 1 for g in got)


def test_rank_counts_across_blocks(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(30, 6)), r.normal(size=(70, 6))
    q = spark.createDataFrame([("b", i, x[i].tolist(), i % 70, y[i % 70].tolist()) for i in range(30)], "db_dataset string, q_row long, vec array<double>, gt_row long, gt_vec array<double>")
    d = spark.createDataFrame([("b", i, y[i].tolist()) for i in range(70)], "db_dataset string, row long, vec array<double>")
    for g in retrieval.rank_counts(q, d, "cosine", query_block=7, candidate_block=11).collect():
        s = y @ x[g.q_row] / np.linalg.norm(y, axis=1) / np.linalg.norm(x[g.q_row])
        assert g.n_candidates == 70 and g.n_better == (s > s[g.q_row % 70] + 1e-12).sum()


def test_retrieval_edge_cases(spark):
    rows = [("one", 1.0, True), ("tie", 2.0, True), ("tie", 2.0, True), ("tie", 1.0, False), ("none", 1.0, True), ("none", 0.5, True), ("nan", 1.0, True), ("nan", None, False), ("near", 1.0 + 5e-13, True), ("near", 1.0, False)]
    df = spark.createDataFrame(rows, "q string, score double, is_positive boolean")
    got = {r.q: r for r in retrieval.summarized(df, ["q"]).collect()}
    assert got["tie"].normalized_rank == 1 and got["tie"].recall_at_1 == 1 and got["tie"].auroc == 1
    assert all(got[k].normalized_rank is None for k in ("one", "none", "nan")) and got["near"].auroc == 1.5


def test_ring_pairs(spark):
    rows = [("d", "ct", f"c{n}", 24.0, 1.0, 10 * n + i) for n in (1, 2, 3, 4) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, cell_type string, cid string, time_h double, dose_um double, row_pos long")
    got = sorted((r.left_row, r.right_row) for r in replicate.ring_pairs(df).collect())
    assert got == sorted([(20, 21), (30, 31), (31, 32), (32, 30), (40, 41), (41, 42), (42, 43), (43, 40)])


def test_bootstrap(spark):
    r = np.random.default_rng(5)
    rows = [("g", f"c{i % 12}", f"s{i % 3}", float(r.normal(5, 1))) for i in range(240)] + [("one", "c", "s", 1.0), ("same", "a", "s", 2.0), ("same", "b", "s", 2.0), ("two", "a", "s", 1.0), ("two", "b", "s", 3.0), ("g", " ", "s0", 99.0), ("g", "c1", "s0", float("nan"))]
    df = spark.createDataFrame(rows, "g string, c string, s string, v double")
    got = {x.g: x for x in bootstrap.bca_table(df, ["g"], "c", ["s"], ["v"]).collect()}
    means = [np.mean([x[3] for x in rows if x[0] == "g" and x[1].strip() and x[2] == f"s{k}" and math.isfinite(x[3])]) for k in range(3)]
    assert math.isclose(got["g"].estimate, np.mean(means)) and got["g"].status == "ok" and got["g"].low < got["g"].estimate < got["g"].high
    assert got["one"].status == "too_few_clusters_or_values" and got["same"].status == "zero_bootstrap_variance" and got["same"].low == 2 and got["two"].status == "too_few_jackknife_values_for_bca"
    again = {x.g: x for x in bootstrap.bca_table(df.repartition(7), ["g"], "c", ["s"], ["v"]).collect()}
    assert again["g"].low == got["g"].low and again["g"].high == got["g"].high


def test_interval_record(spark):
    rows = [("a", f"c{i}", "s", float(i)) for i in range(8)] + [(None, "c", "s", 1.0), ("blank", " ", "s", 1.0), ("nan", "c", "s", float("nan"))]
    df = spark.createDataFrame(rows, "g string, c string, s string, v double")
    table = bootstrap.interval_table(df, ["g"], "c", ["s"], {"value": "v", "again": "v"}, summary_level="g")
    got = {(x.g, x.metric): x for x in table.collect()}
    assert len(got) == 8 and len(table.columns) == 20 and got["a", "value"].mean == 3.5 and got["a", "value"].ci_method == "bca" and got["a", "value"].value_col == "v"
    assert got["a", "value"].ci_low < 3.5 < got["a", "value"].ci_high and got["a", "value"].n_compounds == 8 == got["a", "again"].n_rows
    for g, finite_rows, compounds in ((None, 1, 1), ("blank", 0, 0), ("nan", 0, 0)):
        x = got[g, "value"]
        assert (x.ci_method, x.ci_status, x.mean, x.ci_low, x.n_rows, x.n_finite_rows, x.n_compounds) == ("not_estimable", "too_few_clusters_or_values", None, None, 1, finite_rows, compounds)
    ranges = {x.metric: x for x in bootstrap.half_width_ranges(table).collect()}
    assert ranges["value"].n_intervals == 1 and ranges["value"].ci_methods == "bca" and ranges["value"].max_n_compounds == 8
    assert bootstrap.interval_table(df.filter("false"), ["g"], "c", ["s"], {"value": "v"}).count() == 0


def test_inventory_summary(spark):
    rows = [("x", "CVCL_1", "p", "1", 24.0, 0.1, "False", "A", "blood"), ("x", "CL_1", " ", "nan", 24.0, 1e-7, "False", "A", "blood"), ("x", "CL_2", "q", "2", 6.0, 10.0, "True", "A", None), ("y", "CL_1", "p", "1", 24.0, None, "False", "B", "blood"), ("z", "CL_1", "r", "3", 24.0, 2.0, "no", "B", "liver")]
    schema = "dataset string, cell_type string, perturbagen string, cid string, time_h double, dose_um double, is_control string, assay string, tissue string"
    got = {x.dataset_name: x for x in summaries.inventory_summary(spark.createDataFrame(rows, schema), {"A": "long A"}, {"x": "https://example.org"}).collect()}
    assert [got[k].system for k in "xyz"] == ["cell lines", "primary PBMC", "primary cells"] and [got[k].technology for k in "xyz"] == ["long A", "B", "B"]
    assert (got["x"].n_compounds, got["x"].n_contexts, got["x"].n_samples, got["x"].timepoints_h, got["x"].doses_uM, got["x"].source_url) == (1, 3, 3, "6; 24", "1e-07; 0.1; 10", "https://example.org")
    assert (got["all"].system, got["all"].n_compounds, got["all"].n_samples, got["all"].source_url, got["y"].doses_uM) == ("cell lines; primary PBMC; primary cells", 2, 4, "NA", "")
    with pytest.raises(Exception, match="one assay"):
        summaries.inventory_summary(spark.createDataFrame([*rows, ("y", "CL_1", "p", "1", 24.0, 1.0, "False", "A", "blood")], schema)).collect()


def test_baseline_mean_of_sides_equals_row_mean_of_deltas(spark):
    df = spark.createDataFrame([(1.0, 0.2, 0.4), (1.0, None, 0.4), (1.0, 0.2, None), (1.0, None, None)], "o double, l double, r double")
    o, l, r = F.col("o"), F.col("l"), F.col("r")
    for x in df.select((o - keys.mean_available(l, r)).alias("a"), keys.mean_available(o - l, o - r).alias("b")).collect():
        assert x.a == x.b or math.isclose(x.a, x.b)


def test_files_and_numbering(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, "", 2.5), (3, None, 0.0)], "k long, t string, v double")
    for suffix in (".csv", ".tsv"):
        path = files.write_table(df, str(tmp_path / f"x{suffix}"))
        assert sorted(map(tuple, files.read_table(spark, path, "k long, t string, v double").collect())) == sorted(map(tuple, df.collect()))
    assert files.read_optional(spark, str(tmp_path / "none.tsv"), "a int").count() == 0
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.md").write_text("About Thing: https://example.org/x.")
    (tmp_path / "texts" / "b.bin").write_text("Thing http://no")
    assert [r.url for r in files.first_url(files.read_texts(spark, str(tmp_path / "texts")), "thing").collect()] == ["https://example.org/x."]
    with pytest.raises(KeyError):
        files.required(df, ["k", "missing"])
    n = tables.global_row_number(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), "x")
    assert all(r.n == r.x + 1 for r in n.collect())


def test_incremental_merge(spark, tmp_path):
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)]]):
        spark.createDataFrame(rows, "k long, v string, at long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("k long, v string, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = incremental.merge_stream(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect())[0] == (1, "a")
    assert spark.read.parquet(str(tmp_path / "out" / "v1")).count() == 3


def test_workflows_and_command_line(spark, tmp_path):
    r = np.random.default_rng(8)
    samples, sig = [], []
    for ds in ("p", "q"):
        for i in range(24):
            samples.append((ds, i, f"{ds}{i}", "ct_0", str(i % 12), 24.0, 1.0, False, ds))
            base = np.random.default_rng(i % 12).normal(size=10)
            e = base + r.normal(size=10) * 0.05
            for layer, v in (("logFC", e), ("t", e * 2), ("P.Value", np.exp(-np.abs(e))), ("CI.L", e)):
                sig.append((ds, i, layer, [float(x) for x in v]))
    s = spark.createDataFrame(samples, "dataset string, row_pos long, obs_id string, cell_type string, cid string, time_h double, dose_um double, is_control boolean, source_path string")
    g = spark.createDataFrame(sig, "dataset string, row_pos long, layer string, vec array<float>")
    s.write.parquet(str(tmp_path / "samples"))
    g.write.parquet(str(tmp_path / "signatures"))
    f = spark.createDataFrame([("p", i, f"g{i}") for i in range(10)] + [("q", i, f"g{i}") for i in range(10)], "dataset string, gene_pos int, symbol string")
    settings = workflows.RetrievalSettings(metrics=("cosine",), representations=("logFC", "signed"))
    detail, by_cell, overall = workflows.run_cross_dataset_retrieval(s, g, ["p"], ["q"], settings, features=f)
    rows = detail.collect()
    assert {x.representation for x in rows} == {"logFC", "signed"} and len(rows) == 48 and all(x["rank"] <= 2 for x in rows if x.representation == "logFC")
    assert by_cell.count() == 2 and overall.count() == 2
    found = workflows.build_overlap(s)
    assert found["edges"].count() == 48 and found["components"].count() == 12 and found["annotations"].count() == 48
    agreement = workflows.replicate_agreement(s, g, 3)
    assert agreement["conditions"].count() == 24 and all(x.mean_spearman_logfc > 0.8 for x in agreement["datasets"].collect())
    with pytest.raises(ValueError):
        workflows.RetrievalSettings(metrics=("cosines",))
    with pytest.raises(ValueError):
        cli.parse_metrics("what")
    assert cli.parse_representations("signed, z,logFC") == ("signed", "z", "logFC") and cli.parse_representations("all") == ()
    out = str(tmp_path / "r")
    cli.main(["retrieval", "--samples", str(tmp_path / "samples"), "--signatures", str(tmp_path / "signatures"), "--output", out, "--metrics", "cosine", "--representations", "z", "--db-datasets", "q"])
    assert spark.read.option("header", True).csv(out + "_summary_overall.csv").count() == 1
    cli.main(["summary", "--samples", str(tmp_path / "samples"), "--output", out])
    assert spark.read.option("header", True).option("sep", "\t").csv(out + "_summary.tsv").count() == 3
    cli.main(["summary", "--samples", str(tmp_path / "samples"), "--output", out, "--datasets", "q", "--no-union-row"])
    assert spark.read.option("header", True).option("sep", "\t").csv(out + "_summary.tsv").count() == 1
    again = ["replicate", "--signatures", str(tmp_path / "signatures"), "--top-k", "3"]
    s.filter("dataset = 'p'").write.parquet(str(tmp_path / "one"))
    s.filter("dataset = 'q' or cid in ('1', '2')").write.parquet(str(tmp_path / "more"))
    cli.main([*again, "--samples", str(tmp_path / "one"), "--output", str(tmp_path / "first")])
    cli.main([*again, "--samples", str(tmp_path / "more"), "--output", str(tmp_path / "both"), "--existing-results", str(tmp_path / "first")])
    schema = agreement["conditions"].schema
    read = lambda name: sorted(map(tuple, files.read_table(spark, str(tmp_path / f"{name}_conditions.tsv"), schema).collect()))
    assert len(read("first")) == 12 and len(read("both")) == 24 and set(read("first")) <= set(read("both"))
    assert {x.dataset: x.n_conditions for x in files.read_table(spark, str(tmp_path / "both_datasets.tsv"), agreement["datasets"].schema).collect()} == {"p": 12, "q": 12}
    with pytest.raises(ValueError):
        cli.main([*again, "--samples", str(tmp_path / "more"), "--output", "x", "--existing-results", "x"])
    with pytest.raises(KeyError):
        cli.main(["retrieval", "--samples", str(tmp_path / "samples"), "--signatures", str(tmp_path / "signatures"), "--output", out, "--db-datasets", "nope"])


def test_pair_records_on_themselves(spark):
    x = [0.5, -0.3, 0.9, 0.1, -0.7]
    df = spark.createDataFrame([(x, x, [0.01, 0.01, 0.5, 0.01, 0.01])], "a_lfc array<double>, b_lfc array<double>, a_p array<double>").withColumn("b_p", F.col("a_p"))
    row = pairs.with_masks(df).select(*[c.alias(n) for n, c in pairs.deg_scores((2,)).items()]).first()
    assert row.n_deg_a == 3 and math.isclose(row.spearman_symmetric, 1) and row.direction_agreement == 1 and row.overlap_at_2 == 1


def test_missing_layers_and_tasks_are_reported(spark):
    from accord.operators import datasets, pools

    rows = spark.createDataFrame([(1,), (2,)], "row_pos long")
    vectors = spark.createDataFrame([(1, "across", [0.5]), (1, "within", [0.1]), (2, "across", [0.2])], "row_pos long, layer string, vec array<double>")
    got = {r.row_pos: (r.layer, r.adjusted) for r in datasets.adjusted_vectors(rows, vectors, "within", "across").collect()}
    assert got == {1: ("within", [0.1]), 2: ("across", [0.2])}
    with pytest.raises(Exception, match="no adjusted p-values for row 2"):
        datasets.adjusted_vectors(rows, vectors.filter("row_pos = 1"), "within", "across").collect()
    assert {r.row_pos: r.error for r in pools.assembled(rows, vectors, ["across", "within"]).collect()} == {1: None, 2: "missing: within"}
    with pytest.raises(FileNotFoundError):
        datasets.merged_outputs(rows, [rows.filter("row_pos = 1")], ["row_pos"], strict=True)
    names = spark.createDataFrame([("a/HEPG2_2_de.h5ad",), ("a/HEPG2_1.h5ad",), ("a/MCF7.h5ad",)], "path string")
    assert {r.stem: r.file for r in datasets.first_files(names).collect()} == {"HEPG2": "a/HEPG2_1.h5ad", "MCF7": "a/MCF7.h5ad"}


def test_dose_edges_equal_all_pairs_and_count_edges(spark):
    """Against all pairs of rows: repeated doses, ties on both sides, doses closer than the tolerance, a null and a zero dose."""
    import math
    import random

    rng = random.Random(3)
    doses = [0.0, None, 0.1, 1.0, 1.0 + 2e-13, 10.0, 10.0, 3.0, 0.3, 1e4, float("nan")]
    rows = [(k, f"o{k}", rng.choice("xyz"), rng.choice(["c0", "c1"]), rng.choice(["7", None]), 6.0, rng.choice(doses)) for k in range(90)]
    df = spark.createDataFrame(rows, "row_pos long, obs_id string, dataset string, cell_type string, cid string, time_h double, dose_um double")
    pairs = [(a, b, abs(math.log10(a[6]) - math.log10(b[6]))) for a in rows for b in rows if a[2] < b[2] and a[3] == b[3] and a[4] == b[4] == "7" and (a[6] or 0) > 0 and (b[6] or 0) > 0]
    least = {}
    for a, b, d in pairs:
        for k in ((a[0], b[2]), (b[0], a[2])):
            least[k] = min(d, least.get(k, math.inf))
    want = sorted((a[0], b[0]) for a, b, d in pairs if d <= 1 + 1e-12 and all(abs(d - least[k]) <= 1e-12 for k in ((a[0], b[2]), (b[0], a[2]))))
    assert want and sorted((r.a_row_pos, r.b_row_pos) for r in matching.pair_edges(df).collect()) == want
    got = {(r.a_dataset, r.b_dataset): (r.n_pairs, r.n_left, r.n_right) for r in matching.dose_pair_counts(matching.dose_edges(df), df).collect()}
    name = {r[0]: r[2] for r in rows}
    assert got == {p: (len(e), len({a for a, _ in e}), len({b for _, b in e})) for p in {(name[a], name[b]) for a, b in want} for e in [[(a, b) for a, b in want if (name[a], name[b]) == p]]}


def test_match_samples_join_repeated_ids(spark):
    """Samples of one dose share a text; an obs_id that repeats in a dataset has the matches of all its rows."""
    from accord.operators import datasets

    rows = [(0, "a", "x", 1.0), (1, "a", "x", 10.0), (2, "b", "x", 1.0), (3, "p", "y", 1.0), (4, "q", "y", 10.0)]
    df = spark.createDataFrame([(k, o, d, "c", "7", 6.0, v) for k, o, d, v in rows], "row_pos long, obs_id string, dataset string, cell_type string, cid string, time_h double, dose_um double")
    got = {(r.dataset, r.other, r.obs_id, r.match_ids) for r in datasets.match_samples(matching.dose_edges(df), df).collect()}
    assert got == {("x", "y", "a", "p,q"), ("x", "y", "b", "p"), ("y", "x", "p", "a,b"), ("y", "x", "q", "a")}


def test_pool_records_equal_those_of_scored_rows(spark, monkeypatch):
    """Blocks smaller than the pools; copies of vectors, ties, an undefined vector and one query without a positive."""
    import random

    from accord.functions import vectors as V

    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)] + [[0.0] * 5]
    rows = lambda n, cids: [(k, rng.choice("ab"), rng.choice(cids), vectors[rng.randrange(13 if k % 9 == 0 else 12)]) for k in range(n)]
    q = spark.createDataFrame(rows(31, "123"), "query_id long, place string, cid string, vec array<double>")
    c = spark.createDataFrame(rows(47, "12"), "candidate_id long, place string, cid string, vec array<double>")
    monkeypatch.setattr(retrieval._met, "__defaults__", (4, 7, None))
    for apart in (False, True):
        pool = q.alias("q").join(c.alias("c"), "place").select("query_id", "candidate_id", V.cosine(F.col("q.vec"), F.col("c.vec")).alias("score"), (F.col("q.cid") == F.col("c.cid")).alias("is_positive"))
        pool = pool.filter("query_id <> candidate_id") if apart else pool
        near = lambda rows, names: {r.query_id: tuple(round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in rows}
        records = retrieval.pool_records(q, c, ("place",), apart).cache()
        names = ["n_pool", "n_positive", "best_rank", "normalized_rank", "recall_at_1"]
        assert near(records.collect(), names) == near(retrieval.best_positive_rank(pool, ["query_id"]).collect(), names)
        assert near(records.filter("auroc is not null").collect(), ["auroc"]) == near(retrieval.auroc(pool, ["query_id"]).collect(), ["auroc"])
        names = ["n_pool", "n_positive", "normalized_rank", "recall_at_1", "auroc"]
        assert near(retrieval.pool_summaries(records).collect(), names) == near(retrieval.summarized(pool, ["query_id"]).collect(), names)


def test_nearest_match_settles_equal_distances_as_sql(spark):
    """A dose between two others at the same distance on the logarithmic scale, where the last bit decides."""
    import duckdb

    ties = [(a, q, q * q // a) for q in range(2, 1500) for a in range(max(1, q - 60), q) if q * q % a == 0]
    cases = [(n, str(n), ds, 6.0, v / 100, k) for n, (a, q, b) in enumerate(ties) for k, (ds, v) in enumerate((("x", q), ("y", a), ("y", b)))]
    rows = [(3 * n + k, ds, "c", cid, t, dose) for n, cid, ds, t, dose, k in cases]
    df = spark.createDataFrame(rows, "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double")
    got = {r.q_row_pos: r.db_row_pos for r in matching.nearest_match(df.filter("dataset = 'x'"), df).collect()}
    con = duckdb.connect()
    log = lambda v: con.execute("SELECT ln(?::DOUBLE)", [v / 100]).fetchone()[0]
    for n, (a, q, b) in enumerate(ties):
        x, y, z = log(a), log(q), log(b)
        assert got[3 * n] == 3 * n + (1 if abs(x - y) <= abs(z - y) else 2), (a, q, b)


def test_edges_shuffle_samples_once(spark):
    """Edges and their sums against pair_edges(): repeated doses, nulls, and a key without edges; no row is shuffled twice."""
    import random

    rng = random.Random(5)
    rows = [(k, f"o{k}", rng.choice("xyz"), rng.choice(["c0", "c1", "c2"]), rng.choice(["7", "8", None]), 6.0, rng.choice([None, 0.0, float("nan"), float("inf"), 0.1, 1.0, 3.0, 10.0, rng.random()])) for k in range(150)]
    rows.append((150, "o150", "x", "alone", "7", 6.0, 1.0))
    df = spark.createDataFrame(rows, "row_pos long, obs_id string, dataset string, cell_type string, cid string, time_h double, dose_um double")
    want = {(r.a_dataset, r.b_dataset, r.cid, r.cell_type, r.a_row_pos, r.b_row_pos, r.a_obs_id, r.b_obs_id, r.dose_diff) for r in matching.pair_edges(df).collect()}
    made = matching.exploded(matching.edges_by_dose(df, ("row_pos", "obs_id")))
    got = [(r.a_dataset, r.b_dataset, r.cid, r.cell_type, r.a_row_pos, r.b_row_pos, r.a_obs_id, r.b_obs_id, r.dose_diff) for r in made.collect()]
    assert want and len(got) == len(want) and set(got) == want
    sums = matching.edge_sums(df)
    counts = {(r.a_dataset, r.b_dataset): (r.n_pairs, r.n_compounds, r.n_contexts, r.n_conditions, r.n_left, r.n_right) for r in matching.sum_pair_counts(sums.filter("a_dataset is not null")).collect()}
    assert counts == {(r.a_dataset, r.b_dataset): (r.n_pairs, r.n_compounds, r.n_contexts, r.n_conditions, r.n_left, r.n_right) for r in matching.pair_counts(matching.pair_edges(df)).collect()}
    n = {r.dataset: r.n for r in sums.filter("dataset is not null").groupBy("dataset").agg(F.sum("n_rows").alias("n")).collect()}
    assert n == {x: len({e[4 + k] for e in want for k in (0, 1) if e[k] == x}) for x in "xyz"}
    for frame in (made, sums):
        assert frame.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert not matching.repeats(df, "row_pos") and matching.repeats(df.union(df.limit(1)), "row_pos") and matching.repeats(df, "cid")


def test_deg_records_of_blocks_equal_those_of_rows(spark, monkeypatch):
    """Ties, nulls, NaN, infinite, short, constant and missing vectors, in blocks of few rows."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(24):
        x, q = np.round(rng.normal(size=12), 1).tolist(), np.round(rng.random(12), 1).tolist()
        if k % 6 == 1:
            x[3], x[4], q[5] = None, math.nan, None
        if k % 6 == 2:
            x, q = x[:7], q[: 7 + k % 4]
        if k % 6 == 3:
            x[2] = math.inf
        x, q = {10: None, 11: [0.5] * 12}.get(k, x), {16: None, 11: [0.0] * 12}.get(k, q)
        rows.append((k, "xy"[k % 2], "c", "7", 6.0, 1.0 + k // 8, x, q))
    df = spark.createDataFrame(rows, "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double, lfc array<double>, p array<double>")
    for least in (0.2, None):
        scores = pairs.deg_scores((1, 3))
        old = pairs.with_masks(pairs.pair_vectors(matching.pair_edges(df.drop("lfc", "p")), df, ["lfc", "p"]), 0.6, least).select("a_row_pos", "b_row_pos", *[c.alias(n) for n, c in scores.items()])
        monkeypatch.setattr(pairs, "PAIRS", 8)
        new = pairs.deg_records(matching.edges_by_dose(df, ("row_pos", "lfc", "p")), (1, 3), 0.6, least)
        assert new.columns == old.columns
        for a, b in zip(sorted(old.collect(), key=lambda r: r[:2]), sorted(new.collect(), key=lambda r: r[:2]), strict=True):
            assert all((u is None and v is None) or (u is not None and v is not None and math.isclose(u, v, abs_tol=1e-12)) for u, v in zip(a, b)), (a, b)


@pytest.mark.parametrize("apart", [False, True])
def test_pools_are_scored_in_cells_without_shuffling_scores(spark, monkeypatch, apart):
    """Pools over several cells, a compound over more than one; copies, scores within 1e-12 of each other, nulls and undefined vectors. The only arrays that are shuffled are vectors."""
    import random

    from accord.functions import vectors as V

    rng = random.Random(8)
    vectors = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(9)]
    vectors += [[v * (1 + 1e-13 * rng.random()) for v in vectors[k]] for k in range(4)] + [[0.0] * 5, None]
    rows = lambda n: [(k, rng.choice("ab"), rng.choice(["1", "1", "1", "2", "3", None]), rng.choice(vectors)) for k in range(n)]
    q = spark.createDataFrame([*rows(60), (60, "none", "1", vectors[0]), (61, None, "1", vectors[0])], "query_id long, place string, cid string, vec array<double>")
    c = spark.createDataFrame([*rows(70), (70, "other", "1", vectors[0])], "candidate_id long, place string, cid string, vec array<double>")
    pool = q.alias("q").join(c.alias("c"), "place").select("query_id", "candidate_id", V.cosine(F.col("q.vec"), F.col("c.vec")).alias("score"), F.coalesce(F.col("q.cid") == F.col("c.cid"), F.lit(False)).alias("is_positive"), (F.col("q.cid") != F.col("c.cid")).alias("is_negative"))
    pool = (pool.filter("query_id <> candidate_id") if apart else pool).cache()
    want = {r.query_id: tuple(r)[1:] for r in retrieval.best_positive_rank(pool, ["query_id"]).select("query_id", "n_pool", "n_positive", "best_rank").collect()}
    credit = {r.query_id: r.auroc for r in retrieval.auroc(pool.filter("is_positive or is_negative"), ["query_id"]).collect()}
    for name, value in {"CELL": 4, "MARKS": 40, "CANDIDATE_BLOCK": 6}.items():
        monkeypatch.setattr(retrieval, name, value)
    records = retrieval.pool_records(q, c, ("place",), apart)
    got = records.collect()
    assert len(got) == len(want) and {r.query_id: (r.n_pool, r.n_positive, r.best_rank) for r in got} == want
    assert {r.query_id: r.auroc for r in got if r.auroc is not None} == pytest.approx(credit, abs=1e-12)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "marks" not in plan


def test_equal_doses_are_one_row_before_they_are_shuffled(spark, monkeypatch):
    """A table thirty times over: what reaches the shuffle doesn't grow with the copies, and no edge or row gets lost; rows without equals stay as they are."""
    import random

    rng = random.Random(6)
    doses = [0.1, 1.0, 3.0, 10.0]
    base = [(rng.choice("xy"), "c0", rng.choice("78"), 6.0, rng.choice(doses)) for _ in range(40)]
    rows = [(k, f"o{k}", *row) for k, row in enumerate(base * 30)]
    df = spark.createDataFrame(rows, "row_pos long, obs_id string, dataset string, cell_type string, cid string, time_h double, dose_um double").coalesce(1)
    keys = ("cid", "cell_type", "time_h")
    assert matching._keyed(df, keys).count() == len(set(base)) and matching._keyed(df, keys, "row_pos").count() == len(set(base))
    want = matching.pair_edges(df).select("a_row_pos", "b_row_pos", "a_obs_id", "b_obs_id", "dose_diff")
    for size in (1 << 20, 100, 7):
        monkeypatch.setattr(matching, "COMBINED", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            made = matching.exploded(matching.edges_by_dose(df, ("row_pos", "obs_id"))).select(want.columns)
            assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
            sums = matching.sum_pair_counts(matching.edge_sums(df).filter("a_dataset is not null"))
            assert sums.collect() == matching.pair_counts(matching.pair_edges(df)).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("filled", [1 << 26, 1])
def test_rows_with_vectors_are_combined(spark, monkeypatch, filled):
    """Arrays of arrays, nulls and empty vectors among them: equal doses are one row, and where few are equal, or a batch is full, nothing is lost."""
    monkeypatch.setattr(matching, "COMBINED_BYTES", filled)
    vectors = [[1.0, None], [], None, [math.inf, 2.0, 3.0]]
    rows = [(k, "xy"[k % 2], "c", "7", 6.0, float(k % 4 + 1) if k < 40 else k / 7, vectors[k % 3 + k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double, lfc array<double>").coalesce(1)
    for size in (1000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            for kept in (df, df.filter("row_pos < 40"), df.filter("row_pos < 0")):
                made = matching._keyed(kept, ("cid", "cell_type", "time_h"), "row_pos", "lfc").collect()
                assert sorted((k, r.dataset, r.dose, v) for r in made for k, v in zip(r.row_pos, r.lfc, strict=True)) == sorted((r.row_pos, r.dataset, r.dose_um, r.lfc) for r in kept.collect())
                if size == 1000 and kept.count() == 40:
                    assert len(made) == 4
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def shuffled_rows(spark, job):
    """What job() returns, and the rows that it shuffled."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    return job(), total() - before


def truth(rows, other):
    """truth_sql() of rows in DuckDB: q_dataset, q_row_pos, db_dataset, db_row_pos, time_diff, dose_diff."""
    import duckdb
    import pyarrow as pa

    from accord.plans.fragments import truth_sql

    con, names = duckdb.connect(), "row_pos dataset cell_type cid time_h dose_um".split()
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    con.register("t", pa.table({n: pa.array([r[k] for r in rows], x) for k, (n, x) in enumerate(zip(names, types))}))
    return con.execute(f"WITH {truth_sql('t', other)} SELECT q_dataset, q_row_pos, db_dataset, db_row_pos, time_diff, dose_diff FROM truth").fetchall()


ODD = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -1.0, -3.5, 5e-324, 1e-300, 0.1, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, 3.0, 10.0, 1e15, 1e15 + 1, 1.7e308, -1.7e308]


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("size", [1 << 20, 5])
def test_nearest_match_of_odd_values_equals_sql(spark, monkeypatch, same, size):
    """Nulls, NaN, infinite, negative and hardly different values of time and dose, datasets and keys that are null, and ties once differences are rounded."""
    import random

    from accord.operators import nearest

    rng = random.Random(11)
    dose = lambda: rng.choice([rng.choice(ODD), rng.choice([rng.random(), 1.0 + rng.randrange(9) * 2**-52, rng.choice([0.5, 2.0, 4.0])])])
    rows = [(k, rng.choice(["x", "y", "z", None]), "c", rng.choice(["7", "8", None]), rng.choice([None, math.nan, math.inf, -math.inf, 0.0, 6.0, 6.0, 12.0, 24.0]), dose()) for k in range(500)]
    rows += [(k, rng.choice("xy"), "only numbers", "7", rng.choice([0.0, 6.0, 12.0, 18.0]), rng.choice([1e20, -1e20, *range(40)])) for k in range(500, 700)]
    rows = [(*r[:5], None if r[5] is None else float(r[5])) for r in rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double")
    monkeypatch.setattr(matching, "COMBINED", size)
    for name in ("MATCHED", "ROWS", "CELLS"):
        monkeypatch.setattr(nearest, name, size)
    want = truth(rows, "true" if same else "q.dataset <> d.dataset")
    for database in (df, df.select("*")):
        got = matching.nearest_match(df, database, same_dataset=same).select("q_dataset", "q_row_pos", "db_dataset", "db_row_pos", "time_diff", "dose_diff").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_nearest_match_shuffles_samples_once(spark):
    """A table twenty times over: what is shuffled grows neither with rows of equal key nor with what they can be paired with; copies of a row are one query."""
    import random

    rng = random.Random(3)
    base = [(rng.choice("xyz"), rng.choice(["c0", "c1"]), rng.choice("78"), rng.choice([0.0, 6.0, 12.0]), rng.choice([0.5, 1.0, 2.0, rng.random()])) for _ in range(100)]
    rows = [(k, *row) for k, row in enumerate(base * 20)]
    df = spark.createDataFrame(rows, "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double").coalesce(2).cache()
    context = spark.sparkContext._jsc.sc()

    def stages():
        # Spark forgets old stages, so sums over all of them can fall.
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    last = max(stages(), default=-1)
    made = matching.nearest_match(df, df).select("q_dataset", "q_row_pos", "db_dataset", "db_row_pos", "time_diff", "dose_diff").collect()
    n = sum(v for k, v in stages().items() if k > last)
    assert sorted(map(tuple, made)) == sorted(truth(rows, "q.dataset <> d.dataset"))
    assert 0 < n <= 2 * len({r[:3] for r in base})
    assert matching.nearest_match(df, df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    again = matching.nearest_match(df.union(df.limit(700)), df).select("q_dataset", "q_row_pos", "db_dataset", "db_row_pos", "time_diff", "dose_diff")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, made))


def test_rows_repeated_at_other_doses_are_one_query(spark):
    """A row_pos that a key of a dataset has twice is matched once, where it is the nearest."""
    rows = [(0, "x", "c", "7", 6.0, 1.0), (0, "x", "c", "7", 12.0, 2.0), (0, "x", "c", "7", 12.0, 9.0), (1, "y", "c", "7", 12.0, 8.0), (2, "y", "c", "7", 13.0, 2.0)]
    df = spark.createDataFrame(rows, "row_pos long, dataset string, cell_type string, cid string, time_h double, dose_um double")
    got = [(r.db_row_pos, r.time_diff) for r in matching.nearest_match(df, df).filter("q_dataset = 'x'").collect()]
    assert got == [(1, 0.0)]


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_repeated_ids_are_found_in_runs(spark, kind):
    ids = [*range(70_000, 0, -1), -5, -6, -40_000, 2**31 - 1, -(2**31)]
    df = lambda x, n=3: spark.createDataFrame([(v,) for v in x], "row_pos long").repartition(n).select(F.col("row_pos").cast(kind))
    assert not matching.repeats(df(ids), "row_pos") and not matching.repeats(df([]), "row_pos")
    for odd in ([32_768], [-5], [-40_000], [2**31 - 1], [None]):
        assert matching.repeats(df([*ids, *odd]), "row_pos") and matching.repeats(df([*ids, *odd], 1), "row_pos")
    if kind != "string":
        ordered = spark.range(0, 100_000, 1, 4).select((F.col("id") + 1).cast(kind).alias("row_pos"))
        found, rows = shuffled_rows(spark, lambda: matching.repeats(ordered, "row_pos"))
        assert not found and rows < 100


def test_rows_of_other_edges_are_not_shuffled(spark, monkeypatch):
    from accord.plans import joins

    d = "/root/testdata/sf0.001"
    kept = "a_dataset = 'click' and b_dataset = 'view' and cid < '5' or b_dataset = 'signup' and cell_type = 'ct_1' and cid < '2'"
    want = sorted(map(tuple, joins.edges(spark, d).filter(kept).collect()))
    made, rows = shuffled_rows(spark, lambda: joins.edges(spark, d, lambda e: e.filter(kept)).collect())
    assert want and sorted(map(tuple, made)) == want and rows < 1.5 * joins.event_samples(spark, d).count()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, joins.edges(spark, d, lambda e: e.filter(kept)).collect())) == want


def test_vectors_of_pools_are_shuffled_as_the_table_has_them(spark):
    from accord.plans import rankings

    d = "/root/testdata/sf0.001"
    sides = rankings.pool_sides(spark, d)
    assert all(x.schema["vec"].dataType.simpleString() == "array<float>" for x in sides)
    wide = retrieval.pool_records(*(x.withColumn("vec", F.col("vec").cast("array<double>")) for x in sides), ("cell_type", "time_h"))
    made = rankings.records(spark, d).collect()
    assert made and sorted(map(str, made)) == sorted(map(str, wide.collect()))
