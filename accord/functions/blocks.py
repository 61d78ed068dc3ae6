"""Vector kernels on blocks of rows in numpy: every query of a block against every database row of another."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

GUARD = 1e-12
#: Scores closer than this to the true match's count as equal to it: sums of blocks differ in their last bits.
SAME = 1e-12
DISTANCES = ("mrrmse",)
METRICS = ("cosine", "pearson", "spearman", "mrrmse", "negative_l2")


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1 along the rows."""
    order = np.argsort(x, axis=1, kind="stable")
    sorted_ = np.take_along_axis(x, order, 1)
    n = x.shape[1]
    first = np.zeros_like(order)
    first[:, 1:] = np.where(sorted_[:, 1:] != sorted_[:, :-1], np.arange(1, n), 0)
    first = np.maximum.accumulate(first, axis=1)
    last = np.full_like(order, n - 1)
    last[:, :-1] = np.where(sorted_[:, 1:] != sorted_[:, :-1], np.arange(n - 1), n - 1)
    last = np.minimum.accumulate(last[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows as the metric compares them; rows with a non-finite component become NaN throughout."""
    x = np.array(x, dtype=np.float64)
    bad = ~np.isfinite(x).all(1)
    x[bad] = 0
    if metric == "spearman":
        x = average_ranks(x)
    if metric in ("pearson", "spearman"):
        x = x - x.mean(1, keepdims=True)
    x[bad] = np.nan
    return x


def scores(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs of prepared rows; NaN where undefined."""
    if metric in ("cosine", "pearson", "spearman"):
        a, b = np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1)
        product = a[:, None] * b[None, :]
        with np.errstate(all="ignore"):
            return np.where((a[:, None] > GUARD) & (product > GUARD), (q @ d.T) / product, np.nan)
    square = np.maximum((q * q).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2 * (q @ d.T), 0)
    return np.sqrt(square / q.shape[1]) if metric == "mrrmse" else -np.sqrt(square)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all pairs of rows, added up component by component as in SQL: equal vectors have equal scores in whatever blocks they come, which a matrix product doesn't promise. -inf where undefined."""
    with np.errstate(all="ignore"):
        out, part = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
        a, b = np.zeros(len(x)), np.zeros(len(y))
        for u, v in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
            np.multiply(u[:, None], v[None, :], out=part)
            out += part
            a += u * u
            b += v * v
        a, b = np.sqrt(a), np.sqrt(b)
        np.multiply(a[:, None], b[None, :], out=part)
        out /= part
        out[(part <= GUARD) | (a <= GUARD)[:, None]] = -np.inf
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, added up as in cosines()."""
    out = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for u in np.ascontiguousarray(x.T):
            out += u * u
        return np.sqrt(out)


def rough_cosines(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """cosines() by a matrix product, given the rows' lengths: it differs in the last bits. Undefined ones are -inf as there."""
    with np.errstate(all="ignore"):
        product = a[:, None] * b[None, :]
        out = (x @ y.T) / product
        out[(product <= GUARD) | (a <= GUARD)[:, None]] = -np.inf
    return out


def paired_cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The defined cosines() of the rows i of x with the rows j of y, bit by bit."""
    out = np.zeros(len(i))
    with np.errstate(all="ignore"):
        for u, v in zip(x.T, y.T):
            out += u[i] * v[j]
        return out / (a[i] * b[j])


def pair_scores(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the rows of q with the same rows of d."""
    if metric in ("cosine", "pearson", "spearman"):
        a, b = np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1)
        with np.errstate(all="ignore"):
            return np.where((a > GUARD) & (a * b > GUARD), np.einsum("ij,ij->i", q, d) / (a * b), np.nan)
    # As in scores(), so that a row has the same distance to a match there and here.
    square = np.maximum((q * q).sum(1) + (d * d).sum(1) - 2 * np.einsum("ij,ij->i", q, d), 0)
    return np.sqrt(square / q.shape[1]) if metric == "mrrmse" else -np.sqrt(square)


def signed_and_z(lfc: np.ndarray, p: np.ndarray, low: float = 1e-300, high: float = 1 - 1e-16) -> tuple[np.ndarray, np.ndarray]:
    """-log10 p and the normal quantile of 1 - p/2, each with the sign of the effect, as float32. The quantile is infinite where 1 - p/2 rounds to 1."""
    p = np.clip(np.asarray(p, dtype=np.float64), low, high)
    sign = np.sign(np.asarray(lfc, dtype=np.float64))
    inverse = NormalDist().inv_cdf
    upper = 1 - p / 2
    z = np.array([np.inf if u >= 1 else inverse(u) for u in upper.ravel()]).reshape(p.shape)
    with np.errstate(invalid="ignore"):
        return (-np.log10(p) * sign).astype(np.float32), (sign * z).astype(np.float32)
