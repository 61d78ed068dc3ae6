"""Nearest and mutual-nearest joins of equivalent conditions."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, LongType, StructField, StructType

from accord.operators import nearest

TOLERANCE = 1e-12
#: Rows that a task combines at a time before they are shuffled, and their bytes: vectors fill a batch sooner.
COMBINED = 1 << 20
COMBINED_BYTES = 1 << 26
#: Ids of one part, in which runs of them are compared.
SPAN = 1 << 15


def _logarithms(x: pa.Array) -> pa.Array:
    return pa.array([math.log(v) if v is not None and v > 0 else v if v is not None and v != v else None for v in x.to_pylist()], pa.float64())


def logarithm(x: Column) -> Column:
    """Natural logarithm by the C library, null where it isn't positive. Java's differs in the last bit of some values, which settles otherwise which of two doses at equal distance is the nearer."""
    return F.arrow_udf(_logarithms, DoubleType())(x.cast("double"))


def dose_distance(query: Column, other: Column, log_query: Column, log_other: Column) -> Column:
    """Absolute difference of logarithms where both doses are positive, else of the doses."""
    both = (query > 0) & (other > 0)
    return F.when(both, F.abs(log_other - log_query)).otherwise(F.abs(other - query))


def renamed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def nearest_match(queries: DataFrame, database: DataFrame, keys: tuple[str, ...] = ("cell_type", "cid"), same_dataset: bool = False) -> DataFrame:
    """For each query and database dataset: the database row of equal keys with the least time difference, then dose distance, then row_pos. Differences that are NaN come after all numbers, and null ones last.

    Both frames have row_pos, dataset, time_h, dose_um and the keys; row_pos names a row of its dataset. Rows are shuffled once, gathered
    by key, and a query finds its nearest doses in the sorted ones of a dataset and time, in the one task that holds its key: pairs of rows
    are never made, and results not shuffled.
    """
    by, alone = list(keys), queries is database
    given = [*by, *([] if same_dataset else ["dataset"])]
    place = {"time_h": "double", "dose_um": "double"}

    def side(rows: DataFrame, n: int) -> DataFrame:
        kept = rows.filter(" and ".join(f"`{c}` is not null" for c in given)) if given else rows
        return kept.select(*by, "dataset", F.lit(n).alias("side"), *[F.col(c).cast(t).alias(c) for c, t in place.items()], "row_pos")

    both = side(queries, 0) if alone else side(queries, 0).union(side(database, 1))
    kind = lambda df, c, name: StructField(name, df.schema[c].dataType)
    fields = [*[kind(queries, c, c) for c in by], kind(queries, "dataset", "q_dataset"), kind(queries, "row_pos", "q_row_pos"), kind(database, "dataset", "db_dataset"), kind(database, "row_pos", "db_row_pos")]
    schema = to_arrow_schema(StructType([*fields, StructField("time_diff", DoubleType()), StructField("dose_diff", DoubleType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        key, size = [t[c].combine_chunks().take(pa.array([0])) for c in by], pc.list_value_length(t["row_pos"]).to_numpy()
        time, dose, rows = (t[c].combine_chunks().flatten() for c in ("time_h", "dose_um", "row_pos"))
        names = t["dataset"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, on = (np.repeat(v, size) for v in (names.indices.to_numpy(), t["side"].to_numpy()))
        order = pc.array_sort_indices(rows).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        values = [(x.to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)) for x in (time, dose)]
        # Equal row_pos have one number; null ones are the last.
        by_row = rows.take(pa.array(order))
        number = np.cumsum(np.append(0, pc.fill_null(pc.not_equal(by_row[1:], by_row[:-1]), False).to_numpy(zero_copy_only=False) | (by_row[1:].is_null().to_numpy(zero_copy_only=False) & by_row[:-1].is_valid().to_numpy(zero_copy_only=False))))
        at = [np.flatnonzero(on == n) for n in ((0,) if alone else (0, 1))]
        if not all(len(x) for x in at):
            return
        sides = [nearest.Side(code[x], *(v[x] for v, _ in values), rank[x], *(null[x] for _, null in values)) for x in at]
        # Rows of sides[0] in its order: their positions, and ids by which repeated ones are known.
        own = at[0][sides[0].order]
        ids = number[rank[own]] * (len(names.dictionary) + 1) + code[own]
        repeated = len(np.unique(ids)) < len(ids)
        del t, time, dose, values, on, rank, number, by_row, at
        for unit, dataset, row, dt, dt_class, dd, dd_class in nearest.matched(sides[0], sides[-1], same_dataset, repeated):
            size = np.diff(sides[0].at)[unit]
            ends = np.cumsum(size)
            step = int(ends[-1]) if repeated else nearest.ROWS
            for low in range(0, int(ends[-1]), step):
                k = np.arange(low, min(low + step, int(ends[-1])))
                w = np.searchsorted(ends, k, "right")
                at_row = sides[0].at[unit[w]] + k - (ends[w] - size[w])
                if repeated:
                    kept = nearest.least_of(ids[at_row] * (len(names.dictionary) + 1) + dataset[w], dt_class[w], dt[w], dd_class[w], dd[w], row[w])
                    w, at_row = w[kept], at_row[kept]
                q = own[at_row]
                first = pa.array(np.zeros(len(w), np.int64))
                differences = [pa.array(np.where(c[w] == 1, np.nan, x[w]), mask=c[w] == 2) for x, c in ((dt, dt_class), (dd, dd_class))]
                made = [*(x.take(first) for x in key), names.dictionary.take(pa.array(code[q])), rows.take(pa.array(q)), names.dictionary.take(pa.array(dataset[w])), rows.take(pa.array(order[row[w]])), *differences]
                yield from pa.table([x.cast(f.type) for x, f in zip(made, schema)], schema=schema).to_batches()

    gathered = _combined(both, [*by, "dataset", "side"], (*place, "row_pos"), tuple(place)).repartition(*by)
    return gathered.groupBy(*by).applyInArrow(run, StructType([*fields, StructField("time_diff", DoubleType()), StructField("dose_diff", DoubleType())]))


def candidates_per_compound(queries: DataFrame, database: DataFrame, context: tuple[str, ...] = ("cell_type",)) -> DataFrame:
    """For each query and each compound of another dataset in its context: the row nearest by time, then dose, then row_pos: q_row_pos, db_dataset, db_cid, db_row_pos.

    Queries meet distinct (compound, time) pairs, then the distinct doses at the nearest time; rows of one dose are one, the first.
    """
    by = list(context)
    q = queries.select(*by, *[F.col(c).alias(f"q_{c}") for c in ("dataset", "row_pos", "time_h", "dose_um")]).withColumn("q_log", logarithm(F.col("q_dose_um")))
    d = database.groupBy(*by, *[F.col(c).alias(f"db_{c}") for c in ("dataset", "cid", "time_h", "dose_um")]).agg(F.min("row_pos").alias("db_row_pos")).withColumn("db_log", logarithm(F.col("db_dose_um")))
    times = d.groupBy(*by, "db_dataset", "db_cid").agg(F.collect_set("db_time_h").alias("times"))
    met = q.join(times, by).filter("q_dataset <> db_dataset")
    least = F.array_min(F.transform("times", lambda t: F.abs(t - F.col("q_time_h"))))
    near = met.withColumn("least", least).withColumn("db_time_h", F.explode(F.filter("times", lambda t: F.abs(t - F.col("q_time_h")) == F.col("least")))).drop("times")
    pairs = near.join(d, [*by, "db_dataset", "db_cid", "db_time_h"])
    best = F.min(F.struct(dose_distance(F.col("q_dose_um"), F.col("db_dose_um"), F.col("q_log"), F.col("db_log")).alias("dd"), F.col("db_row_pos").alias("r")))
    return pairs.groupBy("q_row_pos", "db_dataset", "db_cid").agg(best.alias("b")).select("q_row_pos", "db_dataset", "db_cid", F.col("b.r").alias("db_row_pos"))


def axis_minima(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("cid", "cell_type", "time_h")) -> DataFrame:
    """a_dataset, b_dataset, a_row_pos, least: the smallest log10-dose difference of each left row to right rows of equal keys in a later dataset; distinct doses meet, rows don't."""
    by = list(keys)
    l, r = renamed(left, "a_", keys).filter("a_dose_um > 0"), renamed(right, "b_", keys).filter("b_dose_um > 0")
    met = l.select(*by, "a_dataset", "a_dose_um").distinct().join(r.select(*by, "b_dataset", "b_dose_um").distinct(), by).filter("a_dataset < b_dataset")
    least = met.groupBy(*by, "a_dataset", "b_dataset", "a_dose_um").agg(F.min(F.abs(F.log10("a_dose_um") - F.log10("b_dose_um"))).alias("least"))
    return l.select(*by, "a_dataset", "a_dose_um", "a_row_pos").join(least, [*by, "a_dataset", "a_dose_um"]).select("a_dataset", "b_dataset", "a_row_pos", "least")


def _least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest difference of each x to the sorted y."""
    i = np.searchsorted(y, x)
    return np.minimum(np.abs(x - y[np.maximum(i - 1, 0)]), np.abs(x - y[np.minimum(i, len(y) - 1)]))


def _mutual(x: np.ndarray, y: np.ndarray, least_x: np.ndarray, least_y: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in x and in the sorted y, and differences, of pairs that are at most `within` apart and the nearest for both."""
    # What is as near as the nearest one lies at one end of this range: nothing else is in it.
    reach = np.where(least_x <= within + TOLERANCE, least_x + 2 * TOLERANCE, -1.0)
    low = np.searchsorted(y, x - reach)
    size = np.maximum(np.searchsorted(y, x + reach, "right") - low, 0)
    l = np.repeat(np.arange(len(x)), size)
    r = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
    diff = np.abs(x[l] - y[r])
    ok = (diff <= within + TOLERANCE) & (np.abs(diff - least_x[l]) <= TOLERANCE) & (np.abs(diff - least_y[r]) <= TOLERANCE)
    return l[ok], r[ok], diff[ok]


def nearest_doses(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("cid", "cell_type", "time_h"), within: float = 1.0, ordered: str | None = None) -> DataFrame:
    """Pairs of doses of equal keys whose log10 difference is at most `within` and the least for both of them, all ties included: keys, a_dataset, b_dataset, a_dose_um, b_dose_um, dose_diff, n_pairs (of rows).

    ordered: a column whose value must be smaller on the left. A dose finds its nearest ones in the sorted doses of the other
    dataset, so the work is that of a sort and not of all pairs of doses; a key's distinct doses are in one task.
    """
    by = list(keys)
    given = [*by, "dataset", *([ordered] if ordered else [])]

    def doses(rows: DataFrame, side: int) -> DataFrame:
        kept = rows.filter((F.col("dose_um") > 0) & (F.col("dose_um") < float("inf"))).filter(" and ".join(f"`{c}` is not null" for c in given))
        place = F.col(ordered) if ordered else F.lit(0)
        return kept.groupBy(*by, "dataset", F.col("dose_um").cast("double").alias("dose"), place.alias("place"), F.lit(side).alias("side")).agg(F.count(F.lit(1)).alias("n"))

    alone = left is right
    both = doses(left, 0) if alone else doses(left, 0).union(doses(right, 1))
    fields = [both.schema[c] for c in by] + [StructField(f"{x}_dataset", both.schema["dataset"].dataType) for x in "ab"]
    fields += [StructField(c, DoubleType()) for c in ("a_dose_um", "b_dose_um", "dose_diff")] + [StructField("n_pairs", LongType())]
    names = [f.name for f in fields]

    def run(t: pa.Table) -> pa.Table:
        # By side and dataset: the distinct doses, their logarithms, and the numbers of rows at each place.
        sets: dict[tuple, list] = {}
        for k, v in enumerate(zip(t["side"].to_pylist(), t["dataset"].to_pylist())):
            sets.setdefault(v, []).append(k)
        dose, log, n, place = (t[c].to_numpy() for c in ("dose", "log", "n", "place"))
        sides: tuple[list, list] = ([], [])
        for (side, name), rows in sets.items():
            u, first, inverse = np.unique(dose[rows], return_index=True, return_inverse=True)
            at: dict = {}
            for k, p in enumerate(place[rows]):
                at.setdefault(p, []).append(k)
            places = {}
            for p, ks in at.items():
                i = inverse[ks]
                order = np.argsort(i)
                places[p] = (i[order], n[rows][ks][order])
            sides[side].append((name, u, log[rows][first], places))
        out: list[tuple] = []
        for a, ua, xa, pa_ in sides[0]:
            for b, ub, xb, pb_ in sides[0 if alone else 1]:
                met = [(i, j) for p, i in pa_.items() for q, j in pb_.items() if not ordered or p < q]
                la, lb = np.full(len(ua), np.inf), np.full(len(ub), np.inf)
                for (i, _), (j, _) in met:
                    la[i] = np.minimum(la[i], _least(xa[i], xb[j]))
                    lb[j] = np.minimum(lb[j], _least(xb[j], xa[i]))
                found = []
                for (i, ni), (j, nj) in met:
                    l, r, diff = _mutual(xa[i], xb[j], la[i], lb[j], within)
                    found.append((i[l] * len(ub) + j[r], diff, ni[l] * nj[r]))
                if not sum(len(f[0]) for f in found):
                    continue
                code, diff, total = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found))
                if len(found) > 1:
                    each, code, diff = total, *(x[np.unique(code, return_index=True)[1]] for x in (code, diff))
                    total = np.zeros(len(code), np.int64)
                    np.add.at(total, np.searchsorted(code, np.concatenate([f[0] for f in found])), each)
                out.append((a, b, ua[code // len(ub)], ub[code % len(ub)], diff, total))
        if not out:
            return pa.table({f.name: pa.array([], x) for f, x in zip(fields, kinds)})
        sizes = [len(x[2]) for x in out]
        names_a, names_b = ([v for x, size in zip(out, sizes) for v in [x[k]] * size] for k in (0, 1))
        own = t.select(by).slice(0, 1).take(np.zeros(sum(sizes), np.int64))
        return pa.table([*own.columns, pa.array(names_a), pa.array(names_b), *(np.concatenate([x[k] for x in out]) for k in (2, 3, 4, 5))], names=names)

    kinds = [x.type for x in to_arrow_schema(StructType(fields))]
    return both.withColumn("log", F.log10("dose")).groupBy(*by).applyInArrow(run, StructType(fields))


def matched_rows(doses: DataFrame, left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("cid", "cell_type", "time_h")) -> DataFrame:
    """The pairs of rows of pairs of doses (see nearest_doses): keys, a_ and b_ columns, dose_diff. They are made in the last join and not shuffled."""
    by = list(keys)
    l, r = renamed(left, "a_", keys), renamed(right, "b_", keys)
    out = doses.drop("n_pairs").join(l, [*by, "a_dataset", "a_dose_um"]).join(r, [*by, "b_dataset", "b_dose_um"])
    return out.select(*by, *[c for c in l.columns if c not in by], *[c for c in r.columns if c not in by], "dose_diff")


def mutual_nearest(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("cid", "cell_type", "time_h"), within: float = 1.0, ordered: str | None = None) -> DataFrame:
    """Pairs of equal keys whose log10-dose difference is at most `within` and the least for both of them; all ties stay.

    ordered: a column whose value must be smaller on the left, so that one self-join serves all dataset pairs.
    """
    out = matched_rows(nearest_doses(left, right, keys, within, ordered), left, right, keys)
    return out.filter(F.col(f"a_{ordered}") < F.col(f"b_{ordered}")) if ordered and ordered != "dataset" else out


def _gathered(t: pa.Table, by: list[str], carried: tuple[str, ...]) -> tuple[pa.Table, list[pa.Array]]:
    """The distinct `by` columns of t, and arrays of the carried columns for each: of any type, as Arrow gathers positions and not the columns (lists have no such kernel)."""
    g = t.select(by).append_column("_at", pa.array(np.arange(len(t)))).group_by(by, use_threads=False).aggregate([("_at", "list")])
    lists = g["_at_list"].combine_chunks()
    ends, at = pa.array(np.append(0, np.cumsum(lists.value_lengths().to_numpy())), pa.int32()), lists.flatten()
    return g, [pa.ListArray.from_arrays(ends, t[c].combine_chunks().take(at)) for c in carried]


def _combined(rows: DataFrame, by: list[str], carried: tuple[str, ...], ordered: tuple[str, ...] = ()) -> DataFrame:
    """rows with those of equal `by` columns as one, as far as they meet in a task: arrays of the carried columns, or their number n without any. Where few are equal, rows are left as they are. ordered: numbers by which the arrays are sorted, so that equal ones are compressed."""
    fields = [rows.schema[c] for c in by] + ([StructField(c, ArrayType(rows.schema[c].dataType)) for c in carried] or [StructField("n", LongType())])
    schema = to_arrow_schema(StructType(fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, size, filled, useful = [], 0, 0, True
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
                filled += batch.nbytes
            if not size or batch is not None and useful and size < COMBINED and filled < COMBINED_BYTES:
                continue
            t = pa.Table.from_batches(held)
            held, size, filled = [], 0, 0
            if useful:
                if carried:
                    g, more = _gathered(t.take(np.lexsort([t[c].to_numpy() for c in ordered[::-1]])) if ordered else t, by, carried)
                else:
                    g = t.group_by(by, use_threads=False).aggregate([([], "count_all")])
                    more = [g["count_all"]]
                useful = 2 * len(g) < len(t)
            else:
                g, own = t, pa.array(np.arange(len(t) + 1), pa.int32())
                more = [pa.ListArray.from_arrays(own, t[c].combine_chunks()) for c in carried] or [pa.array(np.ones(len(t), np.int64))]
            columns = [*(g[c] for c in by), *more]
            yield from pa.table([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema).to_batches(65_536)

    return rows.mapInArrow(run, StructType(fields))


def _keyed(samples: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    """Rows that can be on an edge: keys, dataset, dose and more (see _combined), those of equal keys in one partition. Rows are shuffled here and not again."""
    given = [*keys, "dataset"]
    kept = samples.filter((F.col("dose_um") > 0) & (F.col("dose_um") < float("inf"))).filter(" and ".join(f"`{c}` is not null" for c in given))
    return _combined(kept.select(*given, F.col("dose_um").cast("double").alias("dose"), *more), [*given, "dose"], more).repartition(*keys)


def _edges_of(t: pa.Table, within: float) -> Iterable[tuple]:
    """a, b, rows of a and of b in t in order of dose, where each distinct dose begins in them, and the pairs of distinct doses on edges: positions l and r, and their differences. For every two datasets with edges, the smaller name first."""
    names, dose, log = t["dataset"].combine_chunks().dictionary_encode(), t["dose"].to_numpy(), t["log"].to_numpy()
    code, found = names.indices.to_numpy(), names.dictionary.to_pylist()
    sets = {}
    for name in sorted(found):
        rows = np.flatnonzero(code == found.index(name))
        rows = rows[np.argsort(dose[rows], kind="stable")]
        first = np.flatnonzero(np.append(True, dose[rows][1:] != dose[rows][:-1]))
        sets[name] = (rows, np.append(first, len(rows)), log[rows[first]])
    for a, (rows_a, at_a, x) in sets.items():
        for b, (rows_b, at_b, y) in sets.items():
            if a < b:
                l, r, diff = _mutual(x, y, _least(x, y), _least(y, x), within)
                if len(l):
                    yield a, b, rows_a, at_a, rows_b, at_b, l, r, diff


def edge_sums(samples: DataFrame, within: float = 1.0, keys: tuple[str, ...] = ("cid", "cell_type", "time_h")) -> DataFrame:
    """keys, a_dataset, b_dataset, n_pairs, n_left, n_right, and dataset, n_rows: the edges of each key between two datasets and the rows on either side of them; in rows of their own (a_dataset null), the rows of each dataset on any edge.

    Edges and pairs of doses are counted in the task that finds them.
    """
    # Equal doses are one before they go to Python.
    doses = _keyed(samples, keys).groupBy(*keys, "dataset", "dose").agg(F.sum("n").alias("n")).withColumn("log", F.log10("dose"))
    kind = doses.schema["dataset"].dataType
    fields = [doses.schema[c] for c in keys] + [StructField("a_dataset", kind), StructField("b_dataset", kind), *[StructField(c, LongType()) for c in ("n_pairs", "n_left", "n_right")], StructField("dataset", kind), StructField("n_rows", LongType())]
    schema = to_arrow_schema(StructType(fields))

    def run(t: pa.Table) -> pa.Table:
        n, out, met = t["n"].to_numpy(), [], {}
        for a, b, rows_a, _, rows_b, _, l, r, _ in _edges_of(t, within):
            left, right = rows_a[np.unique(l)], rows_b[np.unique(r)]
            out.append((a, b, int((n[rows_a[l]] * n[rows_b[r]]).sum()), int(n[left].sum()), int(n[right].sum()), None, None))
            met.setdefault(a, []).append(left)
            met.setdefault(b, []).append(right)
        out += [(None, None, None, None, None, name, int(n[np.unique(np.concatenate(rows))].sum())) for name, rows in met.items()]
        own = [t[c].combine_chunks().take(pa.array(np.zeros(len(out), np.int64))) for c in keys]
        return pa.table([*own, *(pa.array([x[k] for x in out], schema.types[len(keys) + k]) for k in range(7))], names=schema.names)

    return doses.groupBy(*keys).applyInArrow(run, StructType(fields))


def edges_by_dose(samples: DataFrame, carried: tuple[str, ...] = ("row_pos",), within: float = 1.0, keys: tuple[str, ...] = ("cid", "cell_type", "time_h")) -> DataFrame:
    """pair_edges() as pairs of doses with the rows on both sides: keys, a_dataset, b_dataset, a_dose_um, b_dose_um, dose_diff, a and b, arrays of structs of the carried columns. See exploded()."""
    rows = _keyed(samples, keys, *carried).withColumn("log", F.log10("dose"))
    kind, item = rows.schema["dataset"].dataType, ArrayType(StructType([samples.schema[c] for c in carried]))
    fields = [rows.schema[c] for c in keys] + [StructField(f"{x}_dataset", kind) for x in "ab"] + [StructField(c, DoubleType()) for c in ("a_dose_um", "b_dose_um", "dose_diff")] + [StructField(x, item) for x in "ab"]
    schema = to_arrow_schema(StructType(fields))

    def run(t: pa.Table) -> pa.Table:
        values = pa.StructArray.from_arrays([t[c].combine_chunks().flatten() for c in carried], fields=list(schema.field("a").type.value_type))
        own = np.repeat(np.arange(len(t)), pc.list_value_length(t[carried[0]]).to_numpy())
        t = t.drop_columns(list(carried)).take(pa.array(own))
        dose, made = t["dose"].to_numpy(), []

        def lists(rows: np.ndarray, at: np.ndarray, i: np.ndarray) -> pa.Array:
            size = at[i + 1] - at[i]
            ends = np.cumsum(size)
            flat = rows[np.arange(size.sum()) + np.repeat(at[i] - (ends - size), size)]
            return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values.take(pa.array(flat))).cast(schema.field("a").type)

        for a, b, rows_a, at_a, rows_b, at_b, l, r, diff in _edges_of(t, within):
            own = [t[c].combine_chunks().take(pa.array(np.zeros(len(l), np.int64))) for c in keys]
            names = [pa.array([x] * len(l), schema.field("a_dataset").type) for x in (a, b)]
            made.append(pa.table([*own, *names, dose[rows_a[at_a[l]]], dose[rows_b[at_b[r]]], diff, lists(rows_a, at_a, l), lists(rows_b, at_b, r)], schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()

    return rows.groupBy(*keys).applyInArrow(run, StructType(fields))


def exploded(doses: DataFrame) -> DataFrame:
    """The edges of edges_by_dose(): its columns with a_ and b_ carried ones for its arrays. Edges are made here and not shuffled."""
    rest = [c for c in doses.columns if c not in ("a", "b")]
    carried = doses.schema["a"].dataType.elementType.names
    out = doses.withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
    return out.select(*rest, *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in carried])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Runs of consecutive ids of each batch, cut at multiples of SPAN: part, low, high. A batch with a null or an id twice also gives a row of nulls."""
    for batch in batches:
        u = np.unique(batch.column(0).drop_null().cast(pa.int64()).to_numpy())
        cut = np.flatnonzero((u[1:] - u[:-1] != 1) | (u[1:] // SPAN != u[:-1] // SPAN)) + 1
        if len(u):
            low, high = u[np.append(0, cut)], u[np.append(cut - 1, -1)]
            yield pa.record_batch([pa.array(x) for x in (low // SPAN, low, high)], names=["part", "low", "high"])
        if len(u) < batch.num_rows:
            yield pa.record_batch([pa.nulls(1, pa.int64())] * 3, names=["part", "low", "high"])


def repeats(samples: DataFrame, column: str) -> bool:
    """Whether a value of a column (or null) stands on several rows, so that numbers of rows aren't numbers of values. Whole numbers are shuffled as runs, of which a table in order of its ids has few."""
    if not isinstance(samples.schema[column].dataType, IntegralType):
        return not samples.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(column).isNull()).isEmpty()
    runs = samples.select(column).mapInArrow(_runs, "part long, low long, high long")
    before = F.lag("high").over(Window.partitionBy("part").orderBy("low"))
    return not runs.withColumn("before", before).filter("part is null or before >= low").isEmpty()


def dose_edges(samples: DataFrame, within: float = 1.0, keys: tuple[str, ...] = ("cid", "cell_type", "time_h")) -> DataFrame:
    """pair_edges() as pairs of doses with the number of edges (n_pairs) of each."""
    return nearest_doses(samples, samples, keys, within, "dataset")


def matched_samples(doses: DataFrame, samples: DataFrame, keys: tuple[str, ...] = ("cid", "cell_type", "time_h")) -> DataFrame:
    """The samples that a pair of doses matches, each once."""
    side = lambda x: doses.select(*keys, F.col(f"{x}_dataset").alias("dataset"), F.col(f"{x}_dose_um").alias("dose_um"))
    return samples.join(side("a").union(side("b")).distinct(), [*keys, "dataset", "dose_um"], "left_semi")


def rows_of_pairs(samples: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("cid", "cell_type", "time_h"), small: bool = False) -> DataFrame:
    """The samples that can be on an edge of pairs (keys, a_dataset, b_dataset): all of those keys and of either dataset. small: pairs may be broadcast."""
    sides = pairs.select(*keys, F.explode(F.array("a_dataset", "b_dataset")).alias("dataset")).distinct()
    return samples.join(F.broadcast(sides) if small else sides, [*keys, "dataset"], "left_semi")


def side_counts(doses: DataFrame, samples: DataFrame, side: str, name: str, keys: tuple[str, ...] = ("cid", "cell_type", "time_h")) -> DataFrame:
    """a_dataset, b_dataset and the number of distinct row_pos on one side (a or b) of their edges."""
    own = doses.select(*keys, "a_dataset", "b_dataset", f"{side}_dose_um").distinct()
    rows = samples.select(*keys, F.col("dataset").alias(f"{side}_dataset"), F.col("dose_um").alias(f"{side}_dose_um"), "row_pos")
    return own.join(rows, [*keys, f"{side}_dataset", f"{side}_dose_um"]).groupBy("a_dataset", "b_dataset").agg(F.countDistinct("row_pos").alias(name))


def pair_edges(samples: DataFrame, within: float = 1.0, keys: tuple[str, ...] = ("cid", "cell_type", "time_h")) -> DataFrame:
    """Mutual-nearest pairs between every two datasets, the smaller dataset name first, in one job."""
    return mutual_nearest(samples, samples, keys, within, "dataset")


def qualified(pairs: DataFrame, grain: tuple[str, ...] = ("cell_type", "time_h"), compounds: int = 10) -> DataFrame:
    """Pairs in contexts where at least so many distinct compounds match, by dataset pair."""
    by = ["a_dataset", "b_dataset", *grain]
    enough = pairs.groupBy(*by).agg(F.countDistinct("cid").alias("n")).filter(F.col("n") >= compounds).drop("n")
    return pairs.join(enough, by, "left_semi")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Distinct counts of each dataset pair."""
    condition = F.concat_ws("|", "cell_type", "cid", F.col("time_h").cast("string"))
    return pairs.groupBy("a_dataset", "b_dataset").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.countDistinct("cid").alias("n_compounds"),
        F.countDistinct("cell_type").alias("n_contexts"),
        F.countDistinct(condition).alias("n_conditions"),
        F.countDistinct("a_row_pos").alias("n_left"),
        F.countDistinct("b_row_pos").alias("n_right"),
    )


def sum_pair_counts(sums: DataFrame) -> DataFrame:
    """pair_counts() from edge_sums() of samples whose row_pos don't repeat."""
    condition = F.concat_ws("|", "cell_type", "cid", F.col("time_h").cast("string"))
    return sums.groupBy("a_dataset", "b_dataset").agg(
        F.sum("n_pairs").alias("n_pairs"),
        F.countDistinct("cid").alias("n_compounds"),
        F.countDistinct("cell_type").alias("n_contexts"),
        F.countDistinct(condition).alias("n_conditions"),
        F.sum("n_left").alias("n_left"),
        F.sum("n_right").alias("n_right"),
    )


def dose_pair_counts(doses: DataFrame, samples: DataFrame) -> DataFrame:
    """pair_counts() from pairs of doses (see dose_edges) and the samples: edges are counted without being made."""
    condition = F.concat_ws("|", "cell_type", "cid", F.col("time_h").cast("string"))
    counts = doses.groupBy("a_dataset", "b_dataset").agg(
        F.sum("n_pairs").alias("n_pairs"),
        F.countDistinct("cid").alias("n_compounds"),
        F.countDistinct("cell_type").alias("n_contexts"),
        F.countDistinct(condition).alias("n_conditions"),
    )
    both = ["a_dataset", "b_dataset"]
    return counts.join(side_counts(doses, samples, "a", "n_left"), both).join(side_counts(doses, samples, "b", "n_right"), both)


def lookup(requests: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """row_pos of each request by the first key column that finds one, the smallest row_pos of a repeated key; `missing` is true where none does."""
    out = requests
    for n, key in enumerate(keys):
        first = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k{n}")).agg(F.min("row_pos").alias(f"_r{n}"))
        out = out.join(first, out[f"req_{key}"] == F.col(f"_k{n}"), "left").drop(f"_k{n}")
    found = F.coalesce(*[F.col(f"_r{n}") for n in range(len(keys))])
    return out.withColumn("row_pos", found).withColumn("missing", found.isNull()).drop(*[f"_r{n}" for n in range(len(keys))])


def phase_supported(edges: DataFrame, phase: tuple[str, str]) -> DataFrame:
    """Edges between the two phase datasets stay only if their context or their compound occurs on an edge of another dataset pair; other edges stay."""
    is_phase = ((F.col("a_dataset") == phase[0]) & (F.col("b_dataset") == phase[1])) | ((F.col("a_dataset") == phase[1]) & (F.col("b_dataset") == phase[0]))
    other, own = edges.filter(~is_phase), edges.filter(is_phase)
    contexts = other.select("cell_type").distinct().withColumn("by_context", F.lit(True))
    compounds = other.select("cid").distinct().withColumn("by_compound", F.lit(True))
    kept = own.join(contexts, "cell_type", "left").join(compounds, "cid", "left").filter("by_context or by_compound")
    return other.unionByName(kept.select(edges.columns))
