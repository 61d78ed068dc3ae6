"""Scans, filters, projections, scalar functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from accord.functions import keys as K
from accord.functions import vectors as V
from accord.operators import datasets, pools, tables, universe
from accord.plans.fragments import WITH_EVENTS, WITH_SAMPLES, WITH_SIGNATURES
from accord.plans.registry import query, r, rounded
from accord.sources import files
from accord.sources.views import event_samples, read, samples, signatures

BLANK = "trim({c}, ' ' || chr(9) || chr(10) || chr(13))"


@query("src2_cell_types", WITH_SAMPLES + " SELECT DISTINCT dataset, cell_type FROM samples")
def _(s, d):
    return samples(s, d).select("dataset", "cell_type").distinct()


@query("src3_cell_type_scan", WITH_EVENTS + " SELECT row_pos, dataset, cid, dose_um FROM ev WHERE cell_type = 'ct_1'")
def _(s, d):
    return event_samples(s, d).filter("cell_type = 'ct_1'").select("row_pos", "dataset", "cid", "dose_um")


@query("src4_gene_gather", WITH_SIGNATURES + f" SELECT row_pos, {r('lfc[64]', 'g0')}, {r('lfc[3]', 'g1')}, {r('lfc[17]', 'g2')} FROM signatures")
def _(s, d):
    g = V.gather(F.col("lfc"), F.array(F.lit(63), F.lit(2), F.lit(16)))
    return rounded(signatures(s, d).select("row_pos", g[0].alias("g0"), g[1].alias("g1"), g[2].alias("g2")), "g0", "g1", "g2")


META_SQL = """
SELECT o_orderkey AS row_pos, o_orderstatus AS cell_type, CAST(o_custkey AS VARCHAR) AS cid_norm,
  CAST(extract(month FROM o_orderdate) AS DOUBLE) AS time_h, o_totalprice AS dose_um,
  concat_ws('|', o_orderstatus, CAST(o_custkey AS VARCHAR), CAST(CAST(extract(month FROM o_orderdate) AS BIGINT) AS VARCHAR)) AS condition_key
FROM orders WHERE o_orderpriority NOT LIKE '1%' AND o_totalprice > 0
"""


def _metadata(s, d):
    """Orders as sample metadata: status as cell type, customer as compound (written as a float, as sources do), month as time, price as dose."""
    o = read(s, d, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("row_pos"),
        K.clean_text(F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("\t"))).alias("cell_type"),
        K.compound_id(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("cid_norm"),
        K.number(F.concat(F.month("o_orderdate").cast("string"), F.lit(" "))).alias("time_h"),
        F.col("o_totalprice").alias("dose_um"),
        F.col("o_orderpriority").startswith("1").alias("control"),
    )
    kept = rows.filter(K.eligible(F.col("control"), F.col("cell_type"), F.col("cid_norm"), F.col("time_h"), F.col("dose_um")))
    key = K.condition_key(F.col("cell_type"), F.col("cid_norm"), K.number_key(F.col("time_h")))
    return kept.withColumn("condition_key", key).drop("control")


@query("src6_source_metadata", META_SQL)
def _(s, d):
    return _metadata(s, d)


@query("src7_distinct_conditions", f"SELECT DISTINCT cell_type, cid_norm, condition_key FROM ({META_SQL})")
def _(s, d):
    return _metadata(s, d).select("cell_type", "cid_norm", "condition_key").distinct()


@query("src9_overlap_frame", WITH_EVENTS + f" SELECT row_pos, coalesce(nullif(cell_type, 'ct_0'), 'other') AS context, {r('log10(dose_um)', 'log10_dose')} FROM ev WHERE dose_um > 0")
def _(s, d):
    e = event_samples(s, d).filter("dose_um > 0")
    return rounded(e.select("row_pos", F.coalesce(F.nullif("cell_type", F.lit("ct_0")), F.lit("other")).alias("context"), F.log10("dose_um").alias("log10_dose")), "log10_dose")


AXIS_SQL = """
axis AS (
  SELECT source AS source_path, trim(substr(text, 1, 3)) AS gene_key, min(doc_id) AS gene_pos
  FROM documents WHERE trim(substr(coalesce(text, ''), 1, 3), ' ' || chr(9) || chr(10) || chr(13)) <> ''
  GROUP BY ALL
)""".replace("trim(substr(text, 1, 3)) AS", "trim(substr(text, 1, 3), ' ' || chr(9) || chr(10) || chr(13)) AS")


def axis(s, d):
    """The first three characters of documents as gene symbols of their source."""
    f = read(s, d, "documents").select(F.col("source").alias("source_path"), F.col("doc_id").alias("gene_pos"), F.substring("text", 1, 3).alias("symbol"))
    return universe.gene_axis(f)


@query("src10_gene_axis", f"WITH {AXIS_SQL} SELECT * FROM axis")
def _(s, d):
    return axis(s, d)


@query("src11_vectors_for_rows", WITH_SIGNATURES + f" SELECT row_pos, {r('list_sum(lfc[1:32])', 'sum_lfc')}, {r('list_sum(t[1:32])', 'sum_t')} FROM signatures WHERE row_pos IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def _(s, d):
    idx = F.sequence(F.lit(0), F.lit(31))
    rows = read(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("row_pos"))
    got = signatures(s, d).join(rows, "row_pos", "left_semi")
    return rounded(got.select("row_pos", V.total(V.gather(F.col("lfc"), idx)).alias("sum_lfc"), V.total(V.gather(F.col("t"), idx)).alias("sum_t")), "sum_lfc", "sum_t")


@query("src12_adjusted_layer", WITH_SIGNATURES + f" SELECT row_pos, CASE WHEN row_pos % 2 = 0 THEN 'within' ELSE 'across' END AS layer, {r('list_sum(CASE WHEN row_pos % 2 = 0 THEN p ELSE list_transform(p, lambda v: v / 2) END)', 'sum_p')} FROM signatures")
def _(s, d):
    g = signatures(s, d)
    within = F.when(F.col("row_pos") % 2 == 0, F.col("p"))
    across = F.transform("p", lambda v: v / 2)
    layer, chosen = datasets.adjusted_layer(within, across, F.col("row_pos"))
    return rounded(g.select("row_pos", layer.alias("layer"), V.total(chosen).alias("sum_p")), "sum_p")


@query("src14_first_file", "SELECT p_name AS stem, min(p_name || '_' || (p_partkey % 3) || '_de.h5ad') AS file FROM part GROUP BY p_name")
def _(s, d):
    return datasets.first_files(read(s, d, "part").select(F.concat("p_name", F.lit("_"), (F.col("p_partkey") % 3).cast("string"), F.lit("_de.h5ad")).alias("path")))


def _exchange(s, d, suffix):
    path = files.exchange_folder(s) + suffix
    files.write_table(read(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return files.read_table(s, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


SUPPLIERS = "SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey, s_acctbal FROM supplier"


@query("src16_snk1_csv", SUPPLIERS)
def _(s, d):
    return _exchange(s, d, ".csv")


@query("src17_snk2_tsv", SUPPLIERS)
def _(s, d):
    return _exchange(s, d, ".tsv")


@query("src17_missing_file", "SELECT CAST(NULL AS BIGINT) AS a, CAST(NULL AS VARCHAR) AS b WHERE false")
def _(s, d):
    return files.read_optional(s, files.exchange_folder(s) + ".tsv", "a long, b string")


@query("src18_snk5_json_cells", "SELECT n_regionkey AS line, string_agg(n_name, ',' ORDER BY n_name) AS genes, count(*) AS n_genes FROM nation GROUP BY ALL")
def _(s, d):
    cells = read(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("cell"))
    back = cells.select(F.col("n_regionkey").alias("line"), F.from_json("cell", "array<string>").alias("g"))
    return back.select("line", F.array_join("g", ",").alias("genes"), F.size("g").cast("long").alias("n_genes"))


@query("src19_first_url", "SELECT url AS path, regexp_extract(html, '(https?://[^\\s<>\"'')\\]]+)', 1) AS url FROM pages WHERE lower(html) LIKE '%example%' AND regexp_extract(html, '(https?://[^\\s<>\"'')\\]]+)', 1) <> ''")
def _(s, d):
    return files.first_url(read(s, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("text")), "example")


@query("src20_dataset_index", """
WITH l AS (SELECT l_returnflag AS dataset, l_suppkey % 10 AS cell_type, l_partkey AS cid, l_linenumber AS time_h FROM lineitem),
f AS (SELECT * FROM l WHERE cell_type < 7 AND (cell_type, cid) IN (SELECT l_suppkey % 10, l_partkey FROM lineitem WHERE l_quantity > 25))
SELECT dataset, cell_type, cid, time_h, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 2""")
def _(s, d):
    line = read(s, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), (F.col("l_suppkey") % 10).alias("cell_type"), F.col("l_partkey").alias("cid"), F.col("l_linenumber").alias("time_h"), "l_quantity")
    allowed = line.filter("l_quantity > 25").select("cell_type", "cid").distinct()
    return datasets.required_index(datasets.dataset_index(line, cell_types=list(range(7)), line_compounds=allowed), "lineitem")


@query("src22_bridge_rows", "SELECT c_custkey, lower(trim(c_name)) AS name, coalesce(c_mktsegment, '') AS segment FROM customer WHERE lower(c_mktsegment) NOT IN ('building')")
def _(s, d):
    return datasets.bridge_rows(read(s, d, "customer"), "c_custkey", "c_name", "c_mktsegment", ["building"])


# ---------------------------------------------------------------- filters


@query("fil1_numeric_coercion", "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS dose, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def _(s, d):
    e = read(s, d, "events")
    text = F.when(F.col("event_type") == "view", F.lit("x")).otherwise(F.col("value").cast("string"))
    return e.select("event_id", K.number(text).alias("dose"), K.number(F.get_json_object("props", "$.k")).alias("k"))


@query("fil2_eligible", WITH_EVENTS + " SELECT row_pos, dataset FROM ev WHERE dataset <> 'error' AND cid <> '' AND dose_um > 0")
def _(s, d):
    e = event_samples(s, d)
    return e.filter(K.eligible(F.col("dataset") == "error", F.col("cell_type"), F.col("cid"), F.col("time_h"), F.col("dose_um"))).select("row_pos", "dataset")


@query("fil3_valid", WITH_EVENTS + " SELECT dataset, count(*) AS n FROM ev WHERE cid IS NOT NULL GROUP BY ALL")
def _(s, d):
    return event_samples(s, d).filter(K.valid(F.col("cid"), F.col("time_h"), F.col("dose_um"))).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


WORDS = ["True", " yes ", "1", "dmso", "T", "no", "Control", ""]


@query("fil4_control_words", "WITH w AS (SELECT event_id, ['True', ' yes ', '1', 'dmso', 'T', 'no', 'Control', ''][event_id % 8 + 1] AS x FROM events) SELECT event_id, lower(trim(x)) IN ('true', '1', 'yes') AS overlap, lower(trim(x)) IN ('1', 'true', 't', 'yes', 'y', 'dmso', 'control') AS replicate FROM w")
def _(s, d):
    x = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("event_id") % 8 + 1).cast("int"))
    return read(s, d, "events").select("event_id", K.is_control(x, "overlap").alias("overlap"), K.is_control(x, "replicate").alias("replicate"))


@query("fil5_dmso_controls", "SELECT event_id FROM events WHERE event_type = 'click' AND (event_id % 8 = 3 OR json_extract_string(props, '$.k') = '67')")
def _(s, d):
    x = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("event_id") % 8 + 1).cast("int"))
    k = F.get_json_object("props", "$.k")
    cid = F.when(k == "67", F.lit("679.0")).otherwise(k)
    return read(s, d, "events").filter(K.is_dmso(F.col("event_type") == "click", cid, x)).select("event_id")


@query("fil6_selection", WITH_SAMPLES + " SELECT row_pos FROM samples WHERE dataset IN ('ds_a', 'ds_b') AND cell_type NOT IN ('ct_1')")
def _(s, d):
    return samples(s, d).filter(F.col("dataset").isin("ds_a", "ds_b") & ~F.col("cell_type").isin("ct_1")).select("row_pos")


@query("fil7_shared_cell_types", WITH_EVENTS + " SELECT DISTINCT cell_type FROM ev WHERE dataset = 'view' INTERSECT SELECT DISTINCT cell_type FROM ev WHERE dataset = 'click'")
def _(s, d):
    e = event_samples(s, d)
    return e.filter("dataset = 'view'").select("cell_type").intersect(e.filter("dataset = 'click'").select("cell_type"))


@query("fil8_shared_compound", WITH_EVENTS + " SELECT DISTINCT a.cell_type FROM ev a WHERE a.dataset = 'view' AND EXISTS (SELECT 1 FROM ev b WHERE b.dataset = 'click' AND b.cell_type = a.cell_type AND b.cid = a.cid)")
def _(s, d):
    e = event_samples(s, d)
    return e.filter("dataset = 'view'").join(e.filter("dataset = 'click'"), ["cell_type", "cid"], "left_semi").select("cell_type").distinct()


BROKEN = "list_transform(lfc, lambda v, k: CASE WHEN row_pos % 4 = 0 AND k = 5 THEN NULL WHEN row_pos % 7 = 0 AND k = 9 THEN NULL ELSE v END)"


def broken(s, d):
    """Signatures with undefined effects at position 4 of every 4th and 8 of every 7th row."""
    hole = lambda v, k: F.when(((F.col("row_pos") % 4 == 0) & (k == 4)) | ((F.col("row_pos") % 7 == 0) & (k == 8)), F.lit(float("nan"))).otherwise(v)
    return signatures(s, d).withColumn("lfc", F.transform("lfc", hole))


@query("fil9_finite_rows", WITH_SIGNATURES + f" SELECT row_pos FROM (SELECT row_pos, {BROKEN} AS x FROM signatures) WHERE len(list_filter(x, lambda v: v IS NULL)) = 0")
def _(s, d):
    return broken(s, d).filter(V.all_finite(F.col("lfc"))).select("row_pos")


@query("fil10_finite_genes", WITH_SIGNATURES + f", x AS (SELECT dataset, {BROKEN} AS x FROM signatures), c AS (SELECT dataset, unnest(range(0, 64)) AS i, unnest(x) AS v FROM x) SELECT dataset, CAST(i AS BIGINT) AS gene FROM c GROUP BY ALL HAVING count(*) = count(v)")
def _(s, d):
    cells = broken(s, d).select("dataset", F.posexplode("lfc").alias("gene", "v"))
    return cells.groupBy("dataset", "gene").agg(F.bool_and(K.finite(F.col("v"))).alias("ok")).filter("ok").select("dataset", F.col("gene").cast("long").alias("gene"))


@query("fil11_pairwise_finite", WITH_SIGNATURES + f", x AS (SELECT row_pos, {BROKEN} AS x FROM signatures) SELECT a.row_pos, CAST(len(list_filter(range(1, 65), lambda i: a.x[i] IS NOT NULL AND b.x[i] IS NOT NULL)) AS BIGINT) AS n_kept FROM x a JOIN x b ON b.row_pos = a.row_pos + 1")
def _(s, d):
    b = broken(s, d).select("row_pos", "lfc")
    pairs = b.join(b.select((F.col("row_pos") - 1).alias("row_pos"), F.col("lfc").alias("other")), "row_pos")
    return pairs.select("row_pos", F.size(V.pairwise_finite(F.col("lfc"), F.col("other"))[0]).cast("long").alias("n_kept"))


@query("fil12_replicate_count", WITH_EVENTS + " SELECT row_pos FROM ev WHERE (dataset, cell_type, cid, time_h) IN (SELECT dataset, cell_type, cid, time_h FROM ev GROUP BY ALL HAVING count(*) >= 2)")
def _(s, d):
    from accord.operators.replicate import enough_replicates

    return enough_replicates(event_samples(s, d), 2, ("dataset", "cell_type", "cid", "time_h")).select("row_pos")


@query("fil13_stratum_size", WITH_EVENTS + " SELECT dataset, cell_type, time_h, count(DISTINCT cid) AS n_compounds, count(*) AS n_rows FROM ev GROUP BY ALL HAVING count(DISTINCT cid) >= 2 AND count(*) >= 5")
def _(s, d):
    return pools.large_strata(event_samples(s, d), ("dataset", "cell_type", "time_h"))


@query("fil16_retain_flag", WITH_EVENTS + " SELECT DISTINCT e.dataset, e.cell_type, e.cid, e.dataset <> 'view' OR EXISTS (SELECT 1 FROM ev o WHERE o.dataset <> 'view' AND o.cell_type = e.cell_type AND o.cid = e.cid) AS retained FROM ev e")
def _(s, d):
    return datasets.retained(event_samples(s, d), "view").select("dataset", "cell_type", "cid", "retained")


@query("fil17_skipped_rows", WITH_EVENTS + " SELECT row_pos, CASE WHEN dataset = 'error' THEN 'control' ELSE 'dose' END AS reason FROM ev WHERE dataset = 'error' OR NOT dose_um > 1")
def _(s, d):
    reasons = {"control": F.col("dataset") == "error", "dose": ~(F.col("dose_um") > 1)}
    return datasets.rejected(event_samples(s, d), reasons).select("row_pos", "reason")


# ---------------------------------------------------------------- projections and scalars


@query("prj1_derived_keys", WITH_EVENTS + f" SELECT row_pos, printf('%.12g', dose_um) AS dose_key, printf('%.6g', dose_um) AS short_key, {r('log10(dose_um)', 'log10_dose')}, dataset || '::' || row_pos AS replicate_id FROM ev WHERE dose_um > 0")
def _(s, d):
    e = event_samples(s, d).filter("dose_um > 0")
    out = e.select("row_pos", K.number_key(F.col("dose_um")).alias("dose_key"), K.number_key(F.col("dose_um"), "inventory").alias("short_key"), F.log10("dose_um").alias("log10_dose"), K.replicate_id(F.col("dataset"), F.col("row_pos")).alias("replicate_id"))
    return rounded(out, "log10_dose")


@query("prj2_display_order", WITH_EVENTS + " SELECT DISTINCT dataset, upper(dataset) AS label, CASE dataset WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place FROM ev")
def _(s, d):
    e = event_samples(s, d).select("dataset", F.upper("dataset").alias("label")).distinct()
    return tables.ordered_by_names(e, "dataset", ["view", "click"])


@query("prj4_pair_key", "SELECT least(n.n_name, r.r_name) AS low, greatest(n.n_name, r.r_name) AS high, count(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL")
def _(s, d):
    j = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.least("n_name", "r_name").alias("low"), F.greatest("n_name", "r_name").alias("high")).agg(F.count(F.lit(1)).alias("n"))


@query("prj5_normalised_metadata", "SELECT doc_id, lower(coalesce(lang, '')) AS lang, coalesce(source, '') AS source, CAST(n_chars AS DOUBLE) AS n_chars FROM documents")
def _(s, d):
    x = read(s, d, "documents")
    return x.select("doc_id", F.lower(K.clean_text(F.col("lang"))).alias("lang"), K.clean_text(F.col("source")).alias("source"), K.number(F.col("n_chars").cast("string")).alias("n_chars"))


@query("prj6_context_key", "SELECT c_custkey, regexp_replace(c_mktsegment || ' / x', '[^A-Za-z0-9._-]+', '_', 'g') AS context FROM customer")
def _(s, d):
    return read(s, d, "customer").select("c_custkey", K.slug(F.concat("c_mktsegment", F.lit(" / x"))).alias("context"))


@query("scl_string_functions", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS padded, starts_with(s_name, 'Supp') AS starts, split_part(s_name, '#', 2) AS tail, contains(s_name, '00') AS has, coalesce(nullif(trim(CASE WHEN s_suppkey % 2 = 0 THEN ' nan ' ELSE s_name END), 'nan'), 'other') AS first_known FROM supplier")
def _(s, d):
    x = read(s, d, "supplier")
    name = F.when(F.col("s_suppkey") % 2 == 0, " nan ").otherwise(F.col("s_name"))
    return x.select("s_suppkey", K.padded(F.col("s_suppkey")).alias("padded"), F.col("s_name").startswith("Supp").alias("starts"), F.split_part("s_name", F.lit("#"), F.lit(2)).alias("tail"), F.col("s_name").contains("00").alias("has"), K.first_non_empty(name, F.lit("other")).alias("first_known"))


@query("scl_compound_ids", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN 'abc' ELSE '' END AS cid FROM events")
def _(s, d):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(k, F.lit(".0"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), k)).when(F.col("event_id") % 4 == 2, "abc").otherwise(" NaN ")
    return read(s, d, "events").select("event_id", K.compound_id(raw).alias("cid"))


@query("scl_near_integer_keys", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(CAST(round(value) AS BIGINT) AS VARCHAR) ELSE CASE WHEN abs(value - round(value)) <= 1e-8 + 1e-5 * abs(round(value)) THEN CAST(CAST(round(value) AS BIGINT) AS VARCHAR) ELSE printf('%.12g', value) END END AS key FROM events")
def _(s, d):
    v = F.when(F.col("event_id") % 3 == 0, F.round("value") + F.lit(1e-9)).otherwise(F.col("value"))
    return read(s, d, "events").select("event_id", K.number_key(v, "replicate").alias("key"))


@query("scl_math", f"SELECT event_id, {r('ln(value + 1)', 'l')}, {r('sqrt(value)', 's')}, CAST(sign(value - 10) AS DOUBLE) AS g, greatest(least(value, 50.0), 1.0) AS c, {r('pow(value, 0.5)', 'p')} FROM events WHERE value >= 0")
def _(s, d):
    v = F.col("value")
    out = read(s, d, "events").filter("value >= 0").select("event_id", F.ln(v + 1).alias("l"), F.sqrt(v).alias("s"), V.sign(v - 10).alias("g"), F.greatest(F.least(v, F.lit(50.0)), F.lit(1.0)).alias("c"), F.pow(v, F.lit(0.5)).alias("p"))
    return rounded(out, "l", "s", "p")


@query("agg21_reducers", WITH_EVENTS + f", w AS (SELECT row_pos, CASE WHEN row_pos % 2 = 0 THEN dose_um END AS a, CASE WHEN row_pos % 3 = 0 THEN dose_um + 1 END AS b FROM ev) SELECT row_pos, {r('CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END', 'available')}, {r('(a + b) / 2', 'strict')}, {r('a - b', 'difference')} FROM w")
def _(s, d):
    e = event_samples(s, d)
    a, b = F.when(F.col("row_pos") % 2 == 0, F.col("dose_um")), F.when(F.col("row_pos") % 3 == 0, F.col("dose_um") + 1)
    return rounded(e.select("row_pos", K.mean_available(a, b).alias("available"), K.strict_mean(a, b).alias("strict"), K.difference(a, b).alias("difference")), "available", "strict", "difference")
