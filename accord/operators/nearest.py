"""Nearest rows of one key in numpy: for each query and dataset the least time difference, then dose distance, then row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

#: Units of queries (equal dataset, time and dose) that are matched at a time, and rows of a batch.
MATCHED = 1 << 15
ROWS = 1 << 16
#: Time differences that are held at a time.
CELLS = 1 << 20
NONE = np.iinfo(np.int64).max
FINITE, INF, MINUS_INF, NAN, NULL = range(5)
#: By kinds of the query's dose and the other: whether their distance is a number (here infinite, unless both are finite), NaN or null. They sort in this order.
CLASS = np.array([[0, 0, 0, 1, 2], [0, 1, 0, 1, 2], [0, 0, 1, 1, 2], [1, 1, 1, 1, 2], [2, 2, 2, 2, 2]])


def kinds(x: np.ndarray, null: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int8)
    for at, kind in ((x == np.inf, INF), (x == -np.inf, MINUS_INF), (np.isnan(x), NAN), (null, NULL)):
        out[at] = kind
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row begins that differs from the one before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _first(low: np.ndarray, high: np.ndarray, holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first position from low to high (excluded, and given where there is none) at which holds(positions, which): it must hold for all later ones."""
    low, high = low.copy(), high.copy()
    on = np.flatnonzero(low < high)
    while len(on):
        mid = (low[on] + high[on]) >> 1
        yes = holds(mid, on)
        high[on[yes]], low[on[~yes]] = mid[yes], mid[~yes] + 1
        on = on[low[on] < high[on]]
    return low


def _range_least(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least v from low to high (excluded; no range is empty)."""
    out = np.minimum(v[low], v[high - 1])
    size = high - low
    on, level, table = np.flatnonzero(size > 2), 1, v
    while len(on):
        # table[i] is the least of the `level` values from i: two of them cover any range of up to twice the level.
        table, level = np.minimum(table[:-level], table[level:]), 2 * level
        now = on[size[on] <= 2 * level]
        out[now] = np.minimum(table[low[now]], table[high[now] - level])
        on = on[size[on] > 2 * level]
    return out


def closest(y: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least |y - x| among the sorted y from low to high (excluded), and the least row of all y at that distance: differences that are equal once they are rounded are ties. NONE where there are none."""
    at = _first(low, high, lambda k, on: y[k] >= x[on])
    before, behind = at > low, at < high
    with np.errstate(over="ignore", invalid="ignore"):
        left = np.where(before, np.abs(y[np.maximum(at - 1, 0)] - x), np.inf)
        right = np.where(behind, np.abs(y[np.minimum(at, len(y) - 1)] - x), np.inf)
        least = np.minimum(left, right)
        begin, end = at - (before & (left == least)), at + (behind & (right == least))
        more = np.flatnonzero((begin < at) & (begin > low))
        more = more[np.abs(y[begin[more] - 1] - x[more]) == least[more]]
        begin[more] = _first(low[more], begin[more], lambda k, on: np.abs(y[k] - x[more[on]]) <= least[more[on]])
        more = np.flatnonzero((end > at) & (end < high))
        more = more[np.abs(y[end[more]] - x[more]) == least[more]]
        end[more] = _first(end[more], high[more], lambda k, on: np.abs(y[k] - x[more[on]]) > least[more[on]])
    found, rows = np.flatnonzero(begin < end), np.full(len(x), NONE)
    rows[found] = _range_least(row, begin[found], end[found])
    return least, rows


class Side:
    """Rows of one side of a key by dataset (a code), time and dose. A unit is what is equal in all three, a segment in the first two."""

    def __init__(self, dataset: np.ndarray, time: np.ndarray, dose: np.ndarray, rank: np.ndarray, no_time: np.ndarray, no_dose: np.ndarray):
        # Zeros of either sign are one; what is no number is told by its kind.
        time_kind, dose_kind = kinds(time, no_time), kinds(dose, no_dose)
        time, dose = (np.where(k == FINITE, v, 0.0) + 0.0 for k, v in ((time_kind, time), (dose_kind, dose)))
        columns = [rank, dose, dose_kind, time, time_kind, dataset]
        del rank, dose, dose_kind, time, time_kind, dataset
        self.order = np.lexsort(columns)
        for k, v in enumerate(columns):
            columns[k] = v[self.order]
        rank, dose, dose_kind, time, time_kind, dataset = columns
        starts = _changes(dataset, time_kind, time, dose_kind, dose)
        self.at, self.dose, self.kind, self.first = np.append(starts, len(rank)), dose[starts], dose_kind[starts], rank[starts]
        begin = _changes(dataset[starts], time_kind[starts], time[starts])
        self.units = np.append(begin, len(starts))
        self.segment = np.repeat(np.arange(len(begin)), np.diff(self.units))
        self.dataset = dataset[starts][begin]
        kind = time_kind[starts][begin]
        self.no_time = kind == NULL
        self.time = np.select([kind == INF, kind == MINUS_INF, kind >= NAN], [np.inf, -np.inf, np.nan], time[starts][begin])
        positive = np.flatnonzero((self.kind == FINITE) & (self.dose > 0))
        self.log = np.zeros(len(starts))
        # By the C library, as SQL has it: others differ in the last bit of some values.
        for k in range(0, len(positive), ROWS):
            at = positive[k : k + ROWS]
            self.log[at] = [math.log(v) for v in self.dose[at].tolist()]
        self.positive = positive

    def indexed(self) -> Side:
        """What queries need to be matched against this side: where the finite and the positive doses of a segment end and begin, and the least rows by kind."""
        n = len(self.dataset)
        count = lambda which: np.bincount(self.segment[which], minlength=n)
        finite = self.kind == FINITE
        self.low, self.high = self.units[:-1], self.units[:-1] + count(finite)
        self.above = self.high - count(self.positive)
        self.sorted_log, self.log_first = self.log.copy(), self.first.copy()
        order = self.positive[np.lexsort((self.log[self.positive], self.segment[self.positive]))]
        self.sorted_log[self.positive], self.log_first[self.positive] = self.log[order], self.first[order]
        self.least = np.full((5, n), NONE)
        np.minimum.at(self.least, (self.kind, self.segment), self.first)
        return self


def _segments(q: Side, d: Side, same_dataset: bool) -> tuple[np.ndarray, ...]:
    """The segments of d at the nearest times of each dataset for each segment of q, in order of q and dataset: positions in q and d, the time differences and their classes."""
    starts = _changes(d.dataset)
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(d.dataset))))
    found = []
    step = max(1, CELLS // len(d.dataset))
    for a in range(0, len(q.dataset), step):
        rows = slice(a, a + step)
        with np.errstate(invalid="ignore"):
            diff = np.abs(q.time[rows, None] - d.time[None, :])
        kind = np.where(q.no_time[rows, None] | d.no_time[None, :], 2, np.isnan(diff).astype(int))
        if not same_dataset:
            kind[q.dataset[rows, None] == d.dataset[None, :]] = 3
        diff[kind > 0] = 0.0
        best = np.minimum.reduceat(kind, starts, axis=1)[:, which]
        least = np.minimum.reduceat(np.where(kind == best, diff, np.inf), starts, axis=1)[:, which]
        i, j = np.nonzero((kind == best) & (kind < 3) & (diff == least))
        found.append((i + a, j, diff[i, j], kind[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def least_of(group: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """The position of the least row of each group."""
    order = np.lexsort((*by[::-1], group))
    return order[_changes(group[order])]


def matched(q: Side, d: Side, same_dataset: bool, whole: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """unit of q, dataset, row (a rank), time difference and its class, dose distance and its class, by blocks of units (whole: all in one)."""
    d.indexed()
    seg_q, seg_d, time_diff, time_class = _segments(q, d, same_dataset)
    ends = np.cumsum(np.bincount(seg_q, minlength=len(q.dataset)))
    sizes = np.diff(np.append(0, ends))
    step = len(q.segment) if whole else MATCHED
    for a in range(0, len(q.segment), step):
        own = q.segment[a : a + step]
        size = sizes[own]
        total = np.cumsum(size)
        if not total[-1]:
            continue
        unit = np.repeat(np.arange(a, a + len(own)), size)
        pair = np.arange(total[-1]) + np.repeat(ends[own] - total, size)
        seg = seg_d[pair]
        kind, dose = q.kind[unit], q.dose[unit]
        best = [np.full(len(unit), 3), np.zeros(len(unit)), np.full(len(unit), NONE)]

        def offer(at: np.ndarray, c: np.ndarray, distance: np.ndarray, row: np.ndarray, best: list = best) -> None:
            known = row != NONE
            at, c, distance, row = at[known], c[known], distance[known], row[known]
            b, x, r = (v[at] for v in best)
            less = (c < b) | (c == b) & ((distance < x) | (distance == x) & (row < r))
            for v, new in zip(best, (c, distance, row)):
                v[at[less]] = new[less]

        at = np.flatnonzero((kind == FINITE) & (dose > 0))
        s = seg[at]
        offer(at, np.zeros(len(at), int), *closest(d.sorted_log, d.log_first, d.above[s], d.high[s], q.log[unit[at]]))
        # A dose that isn't positive, on either side, is compared as it is.
        at = np.flatnonzero(kind == FINITE)
        s = seg[at]
        high = np.where(dose[at] > 0, d.above[s], d.high[s])
        at, s, high = (v[high > d.low[s]] for v in (at, s, high))
        offer(at, np.zeros(len(at), int), *closest(d.dose, d.first, d.low[s], high, dose[at]))
        for other in range(5):
            at = np.flatnonzero(kind != FINITE) if other == FINITE else np.arange(len(unit))
            row = d.least[other][seg[at]]
            at, row = at[row != NONE], row[row != NONE]
            c = CLASS[kind[at], other]
            offer(at, c, np.where(c == 0, np.inf, 0.0), row)
        dataset, dt, dt_class = d.dataset[seg], time_diff[pair], time_class[pair]
        keep = least_of(unit * (int(d.dataset.max()) + 1) + dataset, *best) if len(_changes(unit, dataset)) < len(unit) else slice(None)
        yield tuple(v[keep] for v in (unit, dataset, best[2], dt, dt_class, best[1], best[0]))
