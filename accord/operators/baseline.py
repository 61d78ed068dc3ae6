"""Leave-one-compound-out baselines: the mean vector of other compounds in the same stratum.

Each baseline is (sum of the stratum - sum of the compound) / (number - own number), position by position, from two
aggregates; no row meets its peers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATUM = ("dataset", "cell_type", "time_h", "dose_um")


def baselines(sig: DataFrame, layer: str, stratum: tuple[str, ...] = STRATUM, mode: str = "finite") -> DataFrame:
    """stratum..., cid, n_peers, baseline (array). mode: "finite" takes the mean of finite values (null where a position has none), "strict" is null at a position where any peer isn't finite; no peers, no row."""
    keys = list(stratum)
    v = F.col("v")
    fine = v.isNotNull() & ~F.isnan("v") & (F.abs(v) < float("inf"))
    cells = sig.select(*keys, "cid", F.posexplode(layer).alias("i", "v"))
    own = cells.groupBy(*keys, "cid", "i").agg(F.sum(F.when(fine, v)).alias("s"), F.count(F.when(fine, 1)).alias("n"), F.count(F.when(~fine, 1)).alias("bad"))
    whole = own.groupBy(*keys, "i").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.sum("bad").alias("tbad"))
    rows = own.join(whole, [*keys, "i"])
    n = F.col("tn") - F.col("n")
    left = F.coalesce("ts", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))
    value = F.when(n > 0, left / F.greatest(n, F.lit(1)))
    if mode == "strict":
        value = F.when(F.col("tbad") - F.col("bad") == 0, value)
    peers = n + F.col("tbad") - F.col("bad")
    out = rows.select(*keys, "cid", "i", value.alias("b"), peers.alias("peers")).groupBy(*keys, "cid").agg(F.max("peers").alias("n_peers"), F.array_sort(F.collect_list(F.struct("i", "b"))).alias("c"))
    return out.filter("n_peers > 0").select(*keys, "cid", "n_peers", F.transform("c", lambda s: s["b"]).alias("baseline"))
