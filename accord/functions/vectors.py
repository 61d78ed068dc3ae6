"""Vector kernels as native column expressions over arrays of doubles.

They are for a few vectors a row; all-pairs scoring runs on Arrow blocks (operators.retrieval). Non-finite components are
null or NaN in the input and handled by the masks here; results that are undefined are null. Ranks need a sort by value and
back with ties averaged, which array functions can't do in less than quadratic time: they are Arrow functions on numpy.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from accord.functions.blocks import average_ranks

GUARD = 1e-12
P_LOW, P_HIGH = 1e-300, 1 - 1e-16


def let(f, *values: Column) -> Column:
    """f of values that are computed once, however often f names them."""
    names = [f"v{i}" for i in range(len(values))]
    bound = F.struct(*[v.alias(n) for n, v in zip(names, values)])
    return F.get(F.transform(F.array(bound), lambda b: f(*[b[n] for n in names])), F.lit(0))


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def gather(vec: Column, idx: Column) -> Column:
    """Components at zero-based positions."""
    return F.transform(idx, lambda i: F.get(vec, i.cast("int")))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return let(lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)), x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return let(lambda v: F.sqrt(dot(v, v)), x)


def all_finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def cosine(x: Column, y: Column) -> Column:
    guarded = lambda a, b, n, m: F.when((n > GUARD) & (n * m > GUARD), dot(a, b) / (n * m))
    return let(lambda a, b: let(guarded, a, b, norm(a), norm(b)), x, y)


def centered(x: Column) -> Column:
    return let(lambda a, m: F.transform(a, lambda v: v - m), x, mean(x))


def pearson(x: Column, y: Column) -> Column:
    return cosine(centered(x), centered(y))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components (nulls as NaN), and where each row's begin and how many they are (-1: null)."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values, np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0), lengths


def _of_length(lists: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, n: int) -> np.ndarray:
    """The named rows, all of length n, as a matrix."""
    values, starts, _ = lists
    return values[starts[rows][:, None] + np.arange(n)]


def _ranks(x: pa.Array) -> pa.Array:
    lists = _lists(x)
    out, fine = np.zeros(len(lists[0])), lists[2] >= 0
    for n in np.unique(lists[2][lists[2] > 0]).tolist():
        rows = np.flatnonzero(lists[2] == n)
        m = _of_length(lists, rows, n)
        out[lists[1][rows][:, None] + np.arange(n)] = average_ranks(m)
        fine[rows] = ~np.isnan(m).any(1)
    ends = np.append(lists[1], len(out)).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(out))
    return made if fine.all() else pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~fine, False)), pa.array(out))


def ranks(x: Column) -> Column:
    """Average ranks from 1; null for an array with null or NaN components."""
    return F.arrow_udf(_ranks, ArrayType(DoubleType()))(doubles(x))


def _spearman(x: pa.Array, y: pa.Array) -> pa.Array:
    a, b = _lists(x), _lists(y)
    out = np.full(len(x), np.nan)
    both = np.where(a[2] == b[2], a[2], -1)
    for n in np.unique(both[both >= 2]).tolist():
        rows = np.flatnonzero(both == n)
        p, q = _of_length(a, rows, n), _of_length(b, rows, n)
        bad = np.isnan(p).any(1) | np.isnan(q).any(1)
        p, q = (average_ranks(m) - (n + 1) / 2 for m in (p, q))
        left, right = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (p, q))
        product = left * right
        known = (left > GUARD) & (product > GUARD) & ~bad
        out[rows[known]] = np.einsum("ij,ij->i", p[known], q[known]) / product[known]
    return pa.array(out, mask=np.isnan(out))


def spearman(x: Column, y: Column) -> Column:
    """Pearson of average ranks; null for fewer than two components, constant ones, and arrays of two lengths or with null or NaN components."""
    return F.arrow_udf(_spearman, DoubleType())(doubles(x), doubles(y))


def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))) / F.size(x))


def negative_l2(x: Column, y: Column) -> Column:
    return -F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def pairwise_finite(x: Column, y: Column) -> tuple[Column, Column]:
    """Both vectors at the positions where both are finite."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    kept = F.filter(F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: fine(s["a"]) & fine(s["b"]))
    return F.transform(kept, lambda s: s["a"]), F.transform(kept, lambda s: s["b"])


def sign(v: Column) -> Column:
    return F.when(v > 0, F.lit(1.0)).when(v < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


def signed_log_p(lfc: Column, p: Column) -> Column:
    """-log10 of p, held within its bounds, with the sign of the effect."""
    return F.zip_with(lfc, p, lambda e, q: -F.log10(F.least(F.greatest(q, F.lit(P_LOW)), F.lit(P_HIGH))) * sign(e))


def signed_significance(lfc: Column, adjusted: Column) -> Column:
    """-log10 of the adjusted p, without an upper bound, with the sign of the effect."""
    return F.zip_with(lfc, adjusted, lambda e, q: -F.log10(F.greatest(q, F.lit(P_LOW))) * sign(e))


def deg_mask(lfc: Column, adjusted: Column, p: float = 0.05, least: float | None = 0.2) -> Column:
    """Whether each component is finite, significant and, if asked, large: strict comparisons in double precision."""

    def test(e, q):
        fine = e.isNotNull() & q.isNotNull() & ~F.isnan(e) & ~F.isnan(q) & (F.abs(e) < float("inf"))
        hit = fine & (q < p)
        return hit if least is None else hit & (F.abs(e) > least)

    return F.zip_with(lfc, adjusted, test)


def order_by_size(x: Column, mask: Column | None = None) -> Column:
    """Positions by falling absolute value, ties by position; of the masked ones only, if there is a mask."""
    items = F.transform(x, lambda v, i: F.struct((-F.abs(v)).alias("v"), i.alias("i")))
    if mask is not None:
        items = F.filter(F.zip_with(items, mask, lambda s, m: F.struct(s["v"].alias("v"), s["i"].alias("i"), m.alias("m"))), lambda s: s["m"])
    return F.transform(F.array_sort(items), lambda s: s["i"])


def order_by_value(x: Column, falling: bool) -> Column:
    """Positions by value, ties by position."""
    return F.transform(F.array_sort(F.transform(x, lambda v, i: F.struct((-v if falling else v).alias("v"), i.alias("i")))), lambda s: s["i"])


def overlap_fraction(a: Column, b: Column, n: int | Column) -> Column:
    """Share of the first n that two lists have in common; null unless n > 0 and both are so long."""
    n = F.lit(n) if isinstance(n, int) else n

    def share(a, b, n):
        both = F.size(F.array_intersect(F.slice(a, 1, F.greatest(n, F.lit(1))), F.slice(b, 1, F.greatest(n, F.lit(1)))))
        return F.when((n > 0) & (F.size(a) >= n) & (F.size(b) >= n), both / n)

    return let(share, a, b, n)


def signed_overlap(x: Column, y: Column, k: int, halved: bool) -> Column:
    """Mean overlap of the k highest and the k lowest positions. halved: k is at most half the length, else at most the length (of 2 or more)."""
    n = F.size(x)
    k_eff = F.least(F.lit(k), F.floor(n / 2).cast("int") if halved else n)
    top = overlap_fraction(order_by_value(x, True), order_by_value(y, True), k_eff)
    low = overlap_fraction(order_by_value(x, False), order_by_value(y, False), k_eff)
    return F.when(n >= (1 if halved else 2), (top + low) / 2)


def direction_agreement(x: Column, y: Column, mask_x: Column, mask_y: Column) -> Column:
    """Share of the positions in both masks whose signs agree."""
    both = F.zip_with(mask_x, mask_y, lambda a, b: a & b)
    same = F.zip_with(F.zip_with(x, y, lambda a, b: F.when(sign(a) == sign(b), 1.0).otherwise(0.0)), both, lambda s, m: F.when(m, s))
    kept = F.filter(same, lambda v: v.isNotNull())
    return mean(kept)


def masked(x: Column, mask: Column) -> Column:
    kept = F.filter(F.zip_with(x, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda s: s["m"])
    return F.transform(kept, lambda s: s["v"])


def mean_abs(x: Column) -> Column:
    return mean(F.transform(x, F.abs))


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m))
