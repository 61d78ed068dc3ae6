"""SQL that several twins share. Each is one or more named subqueries."""

from __future__ import annotations

from accord.sources.views import EVENTS_SQL, SAMPLES_SQL, SIGNATURES_SQL


def edges_sql(t: str, within: float = 1.0, where: str = "a.dataset < b.dataset") -> str:
    keys = "cid, cell_type, time_h, a_dataset, b_dataset"
    return f"""
mnn_pairs AS (
  SELECT a.cid, a.cell_type, a.time_h, a.row_pos AS a_row_pos, b.row_pos AS b_row_pos, a.obs_id AS a_obs_id, b.obs_id AS b_obs_id,
    a.dataset AS a_dataset, b.dataset AS b_dataset, a.dose_um AS a_dose_um, b.dose_um AS b_dose_um, abs(log10(a.dose_um) - log10(b.dose_um)) AS dose_diff
  FROM (SELECT * FROM {t} WHERE dose_um > 0) a JOIN (SELECT * FROM {t} WHERE dose_um > 0) b ON a.cid = b.cid AND a.cell_type = b.cell_type AND a.time_h = b.time_h WHERE {where}
), mnn_least AS (
  SELECT *, min(dose_diff) OVER (PARTITION BY {keys}, a_row_pos) AS la, min(dose_diff) OVER (PARTITION BY {keys}, b_row_pos) AS lb FROM mnn_pairs
), edges AS (
  SELECT * EXCLUDE (la, lb) FROM mnn_least WHERE dose_diff <= {within} + 1e-12 AND abs(dose_diff - la) <= 1e-12 AND abs(dose_diff - lb) <= 1e-12
)"""


def truth_sql(t: str, other: str = "q.dataset <> d.dataset") -> str:
    return f"""
truth_pairs AS (
  SELECT q.cell_type, q.cid, q.dataset AS q_dataset, q.row_pos AS q_row_pos, d.dataset AS db_dataset, d.row_pos AS db_row_pos, abs(q.time_h - d.time_h) AS time_diff,
    CASE WHEN q.dose_um > 0 AND d.dose_um > 0 THEN abs(ln(d.dose_um) - ln(q.dose_um)) ELSE abs(d.dose_um - q.dose_um) END AS dose_diff
  FROM {t} q JOIN {t} d ON q.cell_type = d.cell_type AND q.cid = d.cid WHERE {other}
), truth AS (
  SELECT * FROM truth_pairs QUALIFY row_number() OVER (PARTITION BY q_row_pos, db_dataset ORDER BY time_diff, dose_diff, db_row_pos) = 1
)"""


def total(x: str) -> str:
    return f"list_sum({x})"


def centered(x: str) -> str:
    return f"list_transform({x}, lambda v: v - list_sum({x}) / len({x}))"


def ranks(x: str) -> str:
    return f"list_transform({x}, lambda v: len(list_filter({x}, lambda w: w < v)) + (len(list_filter({x}, lambda w: w = v)) + 1) / 2.0)"


def dot(x: str, y: str) -> str:
    return f"list_dot_product({x}, {y})"


def cosine(x: str, y: str) -> str:
    return f"CASE WHEN sqrt({dot(x, x)}) > 1e-12 AND sqrt({dot(x, x)}) * sqrt({dot(y, y)}) > 1e-12 THEN {dot(x, y)} / (sqrt({dot(x, x)}) * sqrt({dot(y, y)})) END"


def l2(x: str, y: str) -> str:
    return f"list_distance({x}, {y})"


def by_value(x: str, falling: bool, n: str) -> str:
    """The first n positions by value, ties by position."""
    v = f"-{x}[i]" if falling else f"{x}[i]"
    return f"list_transform(list_sort(list_transform(range(1, len({x}) + 1), lambda i: {{'v': {v}, 'i': i}}))[1:{n}], lambda s: s.i)"


def by_size(x: str, mask: str | None = None) -> str:
    """Positions by falling absolute value, of the masked ones only if there is a mask."""
    kept = f"list_filter(range(1, len({x}) + 1), lambda i: {mask}[i])" if mask else f"range(1, len({x}) + 1)"
    return f"list_transform(list_sort(list_transform({kept}, lambda i: {{'v': -abs({x}[i]), 'i': i}})), lambda s: s.i)"


def overlap(a: str, b: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 AND len({a}) >= {n} AND len({b}) >= {n} THEN len(list_intersect({a}[1:{n}], {b}[1:{n}])) / CAST({n} AS DOUBLE) END"


def masked(x: str, mask: str) -> str:
    return f"list_transform(list_filter(range(1, len({x}) + 1), lambda i: {mask}[i]), lambda i: {x}[i])"


WITH_SIGNATURES = "WITH " + SIGNATURES_SQL
WITH_SAMPLES = "WITH " + SAMPLES_SQL
WITH_EVENTS = "WITH " + EVENTS_SQL
