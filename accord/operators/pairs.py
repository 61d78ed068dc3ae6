"""Metrics of matched pairs of signatures: similarity, differential genes, baselines."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accord.functions import vectors as V
from accord.functions.blocks import GUARD, average_ranks
from accord.functions.keys import mean_available, strict_mean


def pair_vectors(pairs: DataFrame, sig: DataFrame, layers: list[str], left: str = "a_row_pos", right: str = "b_row_pos") -> DataFrame:
    """Pairs with the layers of both samples as a_<layer>, b_<layer>."""
    a = sig.select(F.col("row_pos").alias(left), *[F.col(x).alias(f"a_{x}") for x in layers])
    b = sig.select(F.col("row_pos").alias(right), *[F.col(x).alias(f"b_{x}") for x in layers])
    return pairs.join(a, left).join(b, right)


def signature_scores(k: int = 50, halved: bool = True) -> dict[str, Column]:
    """Spearman of effects and of t, signed overlap of t at k, and mean |t| of both sides."""
    return {
        "spearman_lfc": V.spearman(F.col("a_lfc"), F.col("b_lfc")),
        "spearman_t": V.spearman(F.col("a_t"), F.col("b_t")),
        "overlap_t": V.signed_overlap(F.col("a_t"), F.col("b_t"), k, halved),
        "a_mean_abs_t": V.mean_abs(F.col("a_t")),
        "b_mean_abs_t": V.mean_abs(F.col("b_t")),
    }


def deg_scores(ks: tuple[int, ...] = (50, 100, 200), p: float = 0.05, least: float | None = 0.2) -> dict[str, Column]:
    """Differential-gene metrics of a pair with columns a_lfc, a_p, b_lfc, b_p and the masks a_m, b_m (see with_masks)."""
    a, b, ma, mb = F.col("a_lfc"), F.col("b_lfc"), F.col("a_m"), F.col("b_m")
    n_a, n_b = V.count_true(ma), V.count_true(mb)
    rank_a, rank_b = V.order_by_size(a, ma), V.order_by_size(b, mb)
    all_a, all_b = V.order_by_size(a), V.order_by_size(b)
    left, right = V.spearman(V.masked(a, ma), V.masked(b, ma)), V.spearman(V.masked(a, mb), V.masked(b, mb))
    over_left, over_right = V.overlap_fraction(rank_a, all_b, n_a), V.overlap_fraction(rank_b, all_a, n_b)
    out = {
        "n_deg_a": n_a.cast("long"),
        "n_deg_b": n_b.cast("long"),
        "spearman_left": left,
        "spearman_right": right,
        "spearman_symmetric": strict_mean(left, right),
        "overlap_left": over_left,
        "overlap_right": over_right,
        "overlap_symmetric": strict_mean(over_left, over_right),
        "direction_agreement": V.direction_agreement(a, b, ma, mb),
    }
    return out | {f"overlap_at_{k}": V.overlap_fraction(rank_a, rank_b, k) for k in ks}


#: Pairs of a block: its scores are matrices of so many doubles.
PAIRS = 1 << 16


class _Degs:
    """Rows of one side (columns lfc and p) as matrices, filled up with NaN to a width: masks, their sizes, and the positions of components by size."""

    def __init__(self, rows: pa.StructArray, width: int, p: float, least: float | None):
        self.id, self.n = rows.field("row_pos"), len(rows)
        (self.x, hole, self.length), (q, _, length) = (self._full(rows.field(c), width) for c in ("lfc", "p"))
        with np.errstate(invalid="ignore"):
            self.mask = np.isfinite(self.x) & (q < p)
            if least is not None:
                self.mask &= np.abs(self.x) > least
        self.size = self.mask.sum(1)
        self.known = (self.length >= 0) & (length >= 0)
        # Nulls come first and NaN last, as Spark sorts them; what a short row lacks is behind all.
        kind = np.where(np.arange(width) >= self.length[:, None], 3, np.where(hole, 0, np.where(np.isnan(self.x), 2, 1)))
        self.place = self._places(np.where(kind == 1, -np.abs(self.x), 0.0), kind)
        self.own = self._places(np.where(self.mask, -np.abs(self.x), 0.0), ~self.mask)
        self.sign = np.where(self.mask, np.sign(self.x), np.nan)

    @staticmethod
    def _full(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        x, hole, flat, at = np.full((len(column), width), np.nan), np.zeros((len(column), width), bool), column.flatten(), np.arange(width) < length[:, None]
        x[at], hole[at] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
        return x, hole, length

    @staticmethod
    def _places(value: np.ndarray, kind: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, kind), axis=1)
        out = np.empty(order.shape, np.int64)
        np.put_along_axis(out, order, np.arange(order.shape[1])[None, :], 1)
        return out


def _on_masks(a: _Degs, b: _Degs) -> tuple[np.ndarray, np.ndarray]:
    """Spearman on the mask of each row of a with all rows of b, and the share of the mask among b's largest; NaN where undefined."""
    rho, share = np.full((2, a.n, b.n), np.nan)
    for i in range(a.n):
        m, n = a.mask[i], int(a.size[i])
        if n:
            share[i] = np.where(b.length >= n, (b.place[:, m] < n).sum(1) / n, np.nan)
        if n < 2:
            continue
        y = b.x[:, m]
        bad = np.isnan(y).any(1)
        p, q = average_ranks(a.x[i : i + 1, m])[0] - (n + 1) / 2, average_ranks(y) - (n + 1) / 2
        left, right = np.sqrt(p @ p), np.sqrt(np.einsum("ij,ij->i", q, q))
        known = (left > GUARD) & (left * right > GUARD) & ~bad
        rho[i, known] = (q[known] @ p) / (left * right[known])
    return rho, share


def deg_records(doses: DataFrame, ks: tuple[int, ...] = (50, 100, 200), p: float = 0.05, least: float | None = 0.2) -> DataFrame:
    """a_row_pos, b_row_pos and deg_scores() of all edges of matching.edges_by_dose(samples, ("row_pos", "lfc", "p")).

    The rows on both sides of a pair of doses are scored as blocks, so masks and orders are made once a row and vectors are not copied to every edge.
    """
    halves = ["spearman_left", "spearman_right", "spearman_symmetric", "overlap_left", "overlap_right", "overlap_symmetric", "direction_agreement", *[f"overlap_at_{k}" for k in ks]]
    names = ["a_row_pos", "b_row_pos", "n_deg_a", "n_deg_b", *halves]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column("a")[k].values, batch.column("b")[k].values
                width = max([1, *(int(x.field(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max(initial=0)) for x in (left, right) for c in ("lfc", "p"))])
                step = max(1, int(PAIRS**0.5))
                blocks = [[_Degs(x.slice(at, step), width, p, least) for at in range(0, len(x), step)] for x in (left, right)]
                for a in blocks[0]:
                    for b in blocks[1]:
                        yield record(a, b)

    def record(a: _Degs, b: _Degs) -> pa.RecordBatch:
        (rho_a, share_a), (rho_b, share_b) = _on_masks(a, b), (x.T for x in _on_masks(b, a))
        met = a.mask.astype(float) @ b.mask.T.astype(float)
        same = sum((a.sign == v).astype(float) @ (b.sign == v).T.astype(float) for v in (-1, 0, 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = [rho_a, rho_b, (rho_a + rho_b) / 2, share_a, share_b, (share_a + share_b) / 2, np.where(met > 0, same / met, np.nan)]
        for k in ks:
            both = (a.mask & (a.own < k)).astype(float) @ (b.mask & (b.own < k)).T.astype(float)
            scores.append(np.where((k > 0) & (a.size >= k)[:, None] & (b.size >= k)[None, :], both / max(k, 1), np.nan))
        i, j = np.repeat(np.arange(a.n), b.n), np.tile(np.arange(b.n), a.n)
        sizes = [pa.array(x.size[at], pa.int64(), mask=~x.known[at]) for x, at in ((a, i), (b, j))]
        values = [pa.array(x.ravel(), mask=np.isnan(x.ravel())) for x in scores]
        return pa.record_batch([a.id.take(pa.array(i)), b.id.take(pa.array(j)), *sizes, *values], names=names)

    kind = doses.schema["a"].dataType.elementType["row_pos"].dataType.simpleString()
    return doses.select("a", "b").mapInArrow(run, f"a_row_pos {kind}, b_row_pos {kind}, n_deg_a long, n_deg_b long, {', '.join(f'{n} double' for n in halves)}")


def with_masks(pairs: DataFrame, p: float = 0.05, least: float | None = 0.2) -> DataFrame:
    return pairs.withColumn("a_m", V.deg_mask(F.col("a_lfc"), F.col("a_p"), p, least)).withColumn("b_m", V.deg_mask(F.col("b_lfc"), F.col("b_p"), p, least))


def baseline_deg_scores(side: str = "a") -> dict[str, Column]:
    """Sample-referenced metrics against a baseline vector (column base): the baseline is ranked by size alone."""
    x, m, base = F.col(f"{side}_lfc"), F.col(f"{side}_m"), F.col("base")
    n = V.count_true(m)
    return {
        "base_spearman": V.spearman(V.masked(x, m), V.masked(base, m)),
        "base_overlap": V.overlap_fraction(V.order_by_size(x, m), V.order_by_size(base), n),
        "base_direction": V.mean(F.transform(F.filter(F.zip_with(F.zip_with(x, base, lambda a, b: F.when(V.sign(a) == V.sign(b), 1.0).otherwise(0.0)), m, lambda s, k: F.when(k, s)), lambda v: v.isNotNull()), lambda v: v)),
    }


def baseline_scores(pairs: DataFrame, baselines: DataFrame, layer: str, keys: list[str]) -> DataFrame:
    """Each side's score against the baseline of its own stratum and compound, and their available mean: needs a_/b_ columns of the keys, cid and the layer."""
    out = pairs
    for side in ("a", "b"):
        named = baselines.select(*[F.col(c).alias(f"{side}_{c}") for c in keys], "cid", F.col("baseline").alias(f"{side}_base"))
        out = out.join(named, [f"{side}_{c}" for c in keys] + ["cid"], "left").withColumn(f"{side}_baseline", V.spearman(F.col(f"{side}_{layer}"), F.col(f"{side}_base"))).drop(f"{side}_base")
    return out.withColumn("baseline", mean_available(F.col("a_baseline"), F.col("b_baseline")))
