"""Approximate nearest neighbours by cosine: an NN-descent graph, searched greedily.

Equal vectors are one node, so a group of copies of any size is one point of the graph. The graph starts from random
projection leaves (blocks of nodes that lie on the same sides of random planes, compared within the block) and improves by
NN-descent: in each round Spark joins bring together the neighbours and reverse neighbours of every node with their vectors,
and pairs of them that beat a list's last entry enter it, until few entries change. Queries keep a pool of the best nodes
found, seeded with the neighbours of their own node, and expand the unexpanded ones through the graph until the pool stays.
Trees, neighbours and pools grow with the logarithm of the number of nodes. Vectors travel as they are given (in 32 bits where
the column has 32) and all cosines are double-precision, so near copies keep their order; entries of a pool that tie with its
k-th within rounding stay beyond its size, and all entries that good are scored once more for the final order.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accord.llm.common import dropped, mapped, pieces, released, table, written

#: Neighbours of a node and trees up to FEW nodes, and how many more for each doubling of the nodes beyond.
NEIGHBOURS, TREES, FEW, MORE_NEIGHBOURS, MORE_TREES = 32, 8, 1 << 14, 8, 2
#: Nodes of a leaf, share of changed entries at which the rounds end.
LEAF, SETTLED = 1024, 0.02
#: Nodes of a neighbourhood that are compared at once; a larger one is cut at random, anew in each round.
TOGETHER = 256
#: Nodes of a query's pool for each neighbour of a node, bound on the rounding error of a cosine.
POOL, ROUNDING = 1.5, 1e-13

_LIST = "nbrs binary, sims binary"


def sizes(n: int) -> tuple[int, int]:
    """Neighbours of a node and trees for n nodes."""
    doublings = max(0, int(np.ceil(np.log2(max(1, n) / FEW))))
    return NEIGHBOURS + MORE_NEIGHBOURS * doublings, TREES + MORE_TREES * doublings


def _ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int64)


def _floats(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.float64)


def _packed(vectors: np.ndarray) -> list[bytes]:
    """A bytes object a vector: a byte that tells 32 bits from 64, and the components in 32 bits where those hold all of them exactly."""
    with np.errstate(over="ignore"):
        short = vectors.astype(np.float32)
    exact = (short == vectors).all(axis=1)
    return [b"\4" + a.tobytes() if e else b"\10" + b.tobytes() for a, b, e in zip(short, vectors, exact)]


def _unpacked(data: list[bytes]) -> np.ndarray:
    """Double-precision unit vectors; scaled by the largest component first, so that no square over- or underflows."""
    if len({x[0] for x in data}) == 1:
        size = data[0][0]
        x = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), -1)[:, 1:].copy().view(f"f{size}").astype(np.float64)
    else:
        x = np.stack([np.frombuffer(v, f"f{v[0]}", offset=1).astype(np.float64) for v in data]) if data else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _units(column: pa.Array) -> np.ndarray:
    return _unpacked(column.to_pylist())


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Double-precision cosines of the rows of b with a."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max(axis=1, keepdims=True)
    return (b @ a) / (np.sqrt(a @ a) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _vectors(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, vectors) of the rows that take part."""
    rows = [(i, v) for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()) if i is not None and v is not None and len(v) == dimension and None not in v]
    ids = np.array([i for i, _ in rows], dtype=np.int64)
    x = np.array([v for _, v in rows], dtype=np.float64).reshape(len(rows), dimension) + 0.0
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids[fine], x[fine]


def _nodes(embeddings: DataFrame, dimension: int, most: int) -> DataFrame:
    """node (smallest vec_id), ids (the `most` smallest vec_ids), vector (doubles), unit (the vector packed) of every distinct vector."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, x = _vectors(batch, dimension)
        groups: dict[bytes, list[int]] = {}
        for i, v in zip(ids.tolist(), x):
            groups.setdefault(v.tobytes(), []).append(i)
        return pa.record_batch({"vector": pa.array(list(groups), pa.binary()), "ids": pa.array([sorted(set(g))[:most] for g in groups.values()], pa.list_(pa.int64()))})

    def units(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1)
        return pa.record_batch({"node": batch.column("node"), "ids": batch.column("ids"), "vector": batch.column("vector"), "unit": pa.array(_packed(x), pa.binary())})

    # A batch hands on few ids of a vector, so what meets in a group is bounded by the number of batches.
    grouped = mapped(embeddings.select("vec_id", "embedding"), run, "vector binary, ids array<long>").groupBy("vector").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    rows = grouped.select(F.col("ids")[0].alias("node"), F.slice("ids", 1, most).alias("ids"), "vector")
    return written(mapped(rows, units, "node long, ids array<long>, vector binary, unit binary"), "nodes")


def _best(owner: np.ndarray, other: np.ndarray, sims: np.ndarray, k: int) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """Each owner's k most similar others, without repeats, best first and ties to the smaller."""
    order = np.lexsort((other, -sims, owner))
    owner, other, sims = owner[order], other[order], sims[order]
    again = np.zeros(len(owner), dtype=bool)
    pair = np.lexsort((other, owner))
    again[pair[1:]] = (owner[pair[1:]] == owner[pair[:-1]]) & (other[pair[1:]] == other[pair[:-1]])
    owner, other, sims = owner[~again], other[~again], sims[~again]
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(owner)]):
        b = min(b, a + k)
        yield int(owner[a]), other[a:b], sims[a:b]


def _lists(found: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = list(found)
    return pa.record_batch({"node": pa.array([r[0] for r in rows], pa.int64()), "nbrs": pa.array([r[1].astype(np.int64).tobytes() for r in rows], pa.binary()), "sims": pa.array([r[2].astype(np.float64).tobytes() for r in rows], pa.binary())})


class _Gathered:
    """Proposed entries of a task, handed on as short lists whenever many are held."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, owner: np.ndarray, other: np.ndarray, sims: np.ndarray) -> Iterable[pa.RecordBatch]:
        if len(owner):
            self.parts.append((owner, other, sims))
            self.n += len(owner)
        if self.n > 1 << 20:
            yield from self.out()

    def out(self) -> Iterable[pa.RecordBatch]:
        if self.parts:
            yield _lists(_best(*(np.concatenate(x) for x in zip(*self.parts)), self.k))
        self.parts, self.n = [], 0


def _leaves(nodes: DataFrame, n: int, dimension: int, k: int, n_trees: int, seed: int) -> DataFrame:
    """Neighbours within random-projection leaves: short lists of each node, one a tree."""
    depth = max(1, int(np.ceil(np.log2(max(2, n / (LEAF / 2))))))
    planes = np.random.default_rng(seed).normal(size=(n_trees, dimension, depth))

    def codes(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _units(batch.column("unit"))
        out = []
        for t in range(n_trees):
            p = x @ planes[t]
            out.append((((p > 0) * (1 << np.arange(depth))).sum(1), p[:, 0]))
        m = batch.num_rows
        again = np.tile(np.arange(m), n_trees)
        return pa.record_batch({"tree": pa.array(np.repeat(np.arange(n_trees, dtype=np.int32), m)), "code": pa.array(np.concatenate([c for c, _ in out]).astype(np.int64)), "along": pa.array(np.concatenate([p for _, p in out])), "node": batch.column("node").take(pa.array(again)), "unit": batch.column("unit").take(pa.array(again))})

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            ids, x = rows.column("node").to_numpy(), _units(rows.column("unit"))
            sims = x @ x.T
            np.fill_diagonal(sims, -9)
            m = min(k, len(ids) - 1)
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            return _lists((int(ids[i]), ids[top[i]], sims[i, top[i]]) for i in range(len(ids)))

        def full(rows: list[pa.RecordBatch], end: bool) -> Iterable[pa.RecordBatch]:
            whole = pa.Table.from_batches(rows)
            trees = whole.column("tree").to_numpy()
            cuts = [0, *(np.flatnonzero(trees[1:] != trees[:-1]) + 1).tolist(), len(trees)]
            for a, b in zip(cuts, cuts[1:]):
                last = b == len(trees)
                for at in range(a, b, LEAF):
                    part = whole.slice(at, min(LEAF, b - at))
                    if last and not end and part.num_rows < LEAF:
                        yield part
                    elif part.num_rows > 1:
                        yield block(part.combine_chunks())

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * LEAF:
                rest = []
                for made in full(held, False):
                    if isinstance(made, pa.Table):
                        rest = made.to_batches()
                    else:
                        yield made
                held = rest
        if held:
            yield from full(held, True)

    spread = mapped(nodes.select("node", "unit"), codes, "tree int, code long, along double, node long, unit binary")
    return spread.repartitionByRange("tree", "code", "along").sortWithinPartitions("tree", "code", "along", "node").mapInArrow(released(compare), f"node long, {_LIST}")


def _merged(graph: DataFrame, proposals: DataFrame, k: int) -> DataFrame:
    """The graph with proposed entries taken in; fresh marks entries that are new, changed counts them."""
    gathered = proposals.groupBy("node").agg(F.collect_list(F.struct("nbrs", "sims")).alias("more"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for nbrs, sims, more in zip(*(batch.column(c).to_pylist() for c in ("nbrs", "sims", "more"))):
            old = _ints(nbrs)
            others = np.concatenate([old, *(_ints(m["nbrs"]) for m in more or [])])
            values = np.concatenate([_floats(sims), *(_floats(m["sims"]) for m in more or [])])
            new, best = old, _floats(sims)
            for _, new, best in _best(np.zeros(len(others), np.int64), others, values, k):
                pass
            fresh = ~np.isin(new, old)
            out.append((new.tobytes(), best.astype(np.float64).tobytes(), fresh.tobytes(), float(best[-1]) if len(new) == k else -9.0, int(fresh.sum())))
        columns = list(zip(*out))
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int64()]
        names = ["nbrs", "sims", "fresh", "last", "changed"]
        return pa.record_batch([batch.column("node"), batch.column("unit"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["node", "unit", *names])

    rows = graph.join(gathered, "node", "left").select("node", "unit", "nbrs", "sims", "more")
    return written(mapped(rows, run, f"node long, unit binary, {_LIST}, fresh binary, last double, changed long"), "graph")


def _local_join(graph: DataFrame, k: int, round_: int) -> DataFrame:
    """Proposals from one round: all pairs with a fresh member among the neighbours and reverse neighbours of each node."""

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = batch.column("node").to_numpy()
        lists = [_ints(x) for x in batch.column("nbrs").to_pylist()]
        lengths = [len(x) for x in lists]
        a, b = np.repeat(nodes, lengths), np.concatenate(lists) if lists else np.zeros(0, np.int64)
        fresh = np.frombuffer(b"".join(batch.column("fresh").to_pylist()), dtype=bool)
        return pa.record_batch({"hub": pa.array(np.concatenate([a, b])), "member": pa.array(np.concatenate([b, a])), "fresh": pa.array(np.concatenate([fresh, fresh]))})

    pairs = mapped(graph.select("node", "nbrs", "fresh"), edges, "hub long, member long, fresh boolean").groupBy("hub", "member").agg(F.max("fresh").alias("fresh"))
    rows = pairs.join(graph.select(F.col("node").alias("member"), "unit", "last"), "member").repartition("hub").sortWithinPartitions("hub", F.xxhash64("member", F.lit(round_)))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        gathered, held = _Gathered(k), None

        def block(hub, members, fresh, x, last):
            for at in range(0, len(members), TOGETHER):
                m, f, l = members[at : at + TOGETHER], fresh[at : at + TOGETHER], last[at : at + TOGETHER]
                if not f.any():
                    continue
                sims = x[at : at + TOGETHER] @ x[at : at + TOGETHER].T
                np.fill_diagonal(sims, -9)
                i, j = np.nonzero((sims > l[:, None]) & (f[:, None] | f[None, :]))
                yield from gathered.add(m[i], m[j], sims[i, j])

        for batch in batches:
            for piece in pieces(batch):
                now = (piece.column("hub").to_numpy(), piece.column("member").to_numpy(), piece.column("fresh").to_numpy(zero_copy_only=False), _units(piece.column("unit")), piece.column("last").to_numpy())
                if held is not None:
                    now = tuple(np.concatenate(x) for x in zip(held, now))
                hubs = now[0]
                cuts = [0, *(np.flatnonzero(hubs[1:] != hubs[:-1]) + 1).tolist()]
                for a, b in zip(cuts, cuts[1:]):
                    yield from block(*(c[a:b] if n else c[a] for n, c in enumerate(now)))
                a = cuts[-1]
                done = (len(hubs) - a) // TOGETHER * TOGETHER  # a hub's full chunks needn't wait for its end
                if done:
                    yield from block(*(c[a : a + done] if n else c[a] for n, c in enumerate(now)))
                held = tuple(c[a + done :] for c in now)
        if held is not None and len(held[0]):
            yield from block(*(c if n else c[0] for n, c in enumerate(held)))
        yield from gathered.out()

    return rows.select("hub", "member", "fresh", "unit", "last").mapInArrow(released(compare), f"node long, {_LIST}")


def neighbour_graph(nodes: DataFrame, dimension: int, seed: int = 1) -> DataFrame:
    """node, unit, nbrs, sims, fresh, last, changed of every node: its nearest found, best first."""
    spark, n = nodes.sparkSession, nodes.count()
    k, n_trees = sizes(n)
    bare = nodes.select("node", "unit", F.lit(b"").alias("nbrs"), F.lit(b"").alias("sims"))
    graph = _merged(bare, _leaves(nodes, n, dimension, k, n_trees, seed), k)
    for round_ in count():  # each change betters a list, so the changes end
        new = _merged(graph, _local_join(graph, k, round_), k)
        dropped(spark, graph)
        graph = new
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= SETTLED * n * k:
            break
    return graph


def as_good(sims: np.ndarray, k: int) -> int:
    """How many of the cosines, largest first, may be as large as the k-th but for rounding."""
    return len(sims) if len(sims) <= k else int((sims >= sims[k - 1] - 2 * ROUNDING).sum())


def _search(graph: DataFrame, queries: DataFrame, most: int, k: int) -> DataFrame:
    """query node, pool (nodes, best first) of at most `most` and those that tie with the k-th, after a greedy search from the node's own list. queries: distinct nodes of the graph."""
    spark = graph.sparkSession
    schema = "query long, unit binary, pool binary, sims binary, expanded binary, waiting long"

    def seeded(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(_ints(x)) for x in batch.column("nbrs").to_pylist()]
        return pa.record_batch({"query": batch.column("node"), "unit": batch.column("unit"), "pool": batch.column("nbrs"), "sims": batch.column("sims"), "expanded": pa.array([bytes(x) for x in n], pa.binary()), "waiting": pa.array(n, pa.int64())})

    def frontier(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, u = [], []
        for query, pool, expanded in zip(*(batch.column(c).to_pylist() for c in ("query", "pool", "expanded"))):
            open_ = _ints(pool)[np.frombuffer(expanded, dtype=bool) == 0]
            q.append(np.full(len(open_), query, np.int64))
            u.append(open_)
        return pa.record_batch({"query": pa.array(np.concatenate(q)), "node": pa.array(np.concatenate(u))})

    def flat(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [_ints(x) for x in batch.column("nbrs").to_pylist()]
        return pa.record_batch({"query": pa.array(np.repeat(batch.column("query").to_numpy(), [len(x) for x in lists])), "node": pa.array(np.concatenate(lists))})

    def taken(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for query, unit, pool, sims, expanded, more in zip(*(batch.column(c).to_pylist() for c in ("query", "unit", "pool", "sims", "expanded", "more"))):
            ids, values, done = _ints(pool), _floats(sims), np.ones(len(_ints(pool)), dtype=bool)
            if more:
                other = np.array([m["node"] for m in more], dtype=np.int64)
                x = _unpacked([m["unit"] for m in more])
                new = ~np.isin(other, ids) & (other != query)
                ids = np.concatenate([ids, other[new]])
                values = np.concatenate([values, x[new] @ _unpacked([unit])[0]])
                done = np.concatenate([done, np.zeros(int(new.sum()), dtype=bool)])
                best = np.lexsort((ids, -values))
                best = best[: max(most, as_good(values[best], k))]
                ids, values, done = ids[best], values[best], done[best]
            out.append((query, unit, ids.tobytes(), values.astype(np.float64).tobytes(), done.tobytes(), int((~done).sum())))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["query", "unit", "pool", "sims", "expanded", "waiting"])

    state = written(mapped(graph.join(queries.select(F.col("query").alias("node")), "node", "left_semi").select("node", "unit", "nbrs", "sims"), seeded, schema), "pool")
    while state.filter("waiting > 0").limit(1).count():  # each node is expanded while in the pool, and the pool only betters
        steps = mapped(state.filter("waiting > 0").select("query", "pool", "expanded"), frontier, "query long, node long")
        reached = mapped(steps.join(graph.select("node", "nbrs"), "node").select("query", "nbrs"), flat, "query long, node long").distinct()
        met = reached.join(graph.select("node", "unit"), "node").groupBy("query").agg(F.collect_list(F.struct("node", "unit")).alias("more"))
        new = written(mapped(state.join(met, "query", "left"), taken, schema), "pool")
        dropped(spark, state)
        state = new
    return state


def nearest(embeddings: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by double-precision cosine, ties to the smaller vec_id.

    is_query: condition on vec_id. A query's own vec_id is no candidate, other rows with its vector are. Vectors that are
    null, all zero, or hold null or non-finite components take no part, nor do those of another length than the commonest
    (ties: the longer), nor null vec_ids. Rows that repeat a vec_id and its vector count once. Other columns play no part.
    """
    known = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = known.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dimension = lengths["d"]
    nodes = _nodes(known, dimension, k + 1)

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, x = _vectors(batch, dimension)
        return pa.record_batch({"query_id": pa.array(ids), "vector": pa.array([v.tobytes() for v in x], pa.binary())})

    asked = mapped(known.filter(is_query(F.col("vec_id"))), keys, "query_id long, vector binary").distinct()
    placed = written(asked.join(nodes.select("vector", F.col("node").alias("query"), "ids"), "vector").select("query_id", "query", "ids"), "queries")
    graph = neighbour_graph(nodes, dimension)
    pools = _search(graph, placed.select("query").distinct(), int(POOL * sizes(nodes.count())[0]), k + 1)

    def candidates(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [np.concatenate([[q], _ints(p)[: as_good(_floats(s), k + 1)]]) for q, p, s in zip(*(batch.column(c).to_pylist() for c in ("query", "pool", "sims")))]
        return pa.record_batch({"query": pa.array(np.repeat(batch.column("query").to_numpy(), [len(x) for x in lists])), "node": pa.array(np.concatenate(lists))})

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for query, found in zip(batch.column("query").to_pylist(), batch.column("found").to_pylist()):
            own = next(f["vector"] for f in found if f["node"] == query)
            scores = cosine(np.frombuffer(own), np.stack([np.frombuffer(f["vector"]) for f in found])).tolist()
            ids = sorted((-s, i) for s, f in zip(scores, found) for i in f["ids"])[: k + 1]
            out.append((query, [{"vec_id": i, "score": -s} for s, i in ids]))
        return pa.record_batch({"query": pa.array([x[0] for x in out], pa.int64()), "best": pa.array([x[1] for x in out], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))})

    rows = mapped(pools.select("query", "pool", "sims"), candidates, "query long, node long").join(nodes.select("node", "vector", "ids"), "node")
    best = mapped(rows.groupBy("query").agg(F.collect_list(F.struct("node", "vector", "ids")).alias("found")), exact, "query long, best array<struct<vec_id: long, score: double>>")
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = placed.join(best, "query").select("query_id", F.posexplode(own).alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 nearest found of each row of `embeddings` whose vec_id is divisible by 50.

    Null, zero, non-finite and odd-length vectors and null ids take no part; ties go to the smaller vec_id; equal vectors of
    several ids are candidates each; repeated rows count once; an empty table gives an empty one; other columns play no part.
    """
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)
