"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of 5-word shingles; texts with one set form a class and only its smallest doc_id goes on. Band keys of
MinHash signatures give buckets. Two classes are compared in a bucket by signature batches in turn, and a pair is dropped as
soon as the posterior probability that its similarity reaches the threshold falls below the chosen miss probability (uniform
prior; the posterior after m of n agreements is a Beta distribution, whose tail is a binomial sum). Survivors are verified on
their full sets.

Pairs are compared in two passes. First every class meets the smallest member of its buckets, so a group of near copies
becomes one star. Then only buckets that still hold several components are looked at: members outside a bucket's largest
component meet each other and those inside it, and a pair of one component is not compared. So the work on a group of n near
copies grows with n, not with its square, while no link between components is left out. Both passes deal members out in
chunks, so no task grows with a group; what leaves a task is one star for each group of verified links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accord.llm.common import mapped, pieces, released, small, table, with_texts, written
from accord.llm.components import components
from accord.llm.words import mix64, multipliers, shingle_sets

BANDS, ROWS = 26, 5
HASHES = BANDS * ROWS
#: Hashes compared in turn; after each batch, pairs are pruned.
BATCHES = (32, 64, 96, HASHES)
#: Bytes of text that are hashed at once: the arrays on the way take some forty times as much.
HASHED = 1 << 20
#: Members of a bucket's chunk, of which two are compared in one task, and members that meet one copy of their centre.
BLOCK, STAR = 1024, 128

#: What tells blocks apart, and the columns of a member of one: comp is the component that it is known to be in, centre the id that it has met.
BY = ["key", "i", "j"]
_MEMBERS = "id long, f1 long, band int, key long, i int, j int, side int, comp long, centre long"
_MEMBER = [x.split()[0] for x in _MEMBERS.split(", ")]
#: In place of a centre.
NO_ID = -(1 << 63)

_A = (multipliers(HASHES, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (multipliers(HASHES, 77) >> np.uint64(31)).astype(np.uint32)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The smallest m for which P(similarity >= threshold | m of n hashes agree) >= miss, under a uniform prior."""
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of HASHES hash functions over a set (of at least one shingle)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = None
    for at in range(0, len(x), 4096):
        low = ((x[at : at + 4096, None] ^ _B) * _A).min(0)
        out = low if out is None else np.minimum(out, low)
    return out


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that tell different sets apart."""
    with np.errstate(over="ignore"):
        first = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
        second = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return first.view(np.int64), second.view(np.int64)


_SETS = "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sig binary"


def _summaries(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = shingle_sets(batch.column("text"))
    f1, f2 = _prints(sets)
    none = np.zeros(HASHES, np.uint32)
    sigs = np.stack([signature(s) if len(s) else none for s in sets]).astype(np.uint16)
    with np.errstate(over="ignore"):
        keys = mix64((sigs.reshape(-1, BANDS, ROWS).astype(np.uint64) * multipliers(HASHES, 33).reshape(BANDS, ROWS)).sum(2) + np.arange(BANDS, dtype=np.uint64))
    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
    n = pa.array([len(s) for s in sets], pa.int64())
    return pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": n, "f1": pa.array(f1), "f2": pa.array(f2), "keys": lists, "sig": pa.array([s.tobytes() for s in sigs], pa.binary())})


class Block:
    """Members that meet in one task: rows of one key and pair of chunks, sorted by id."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.ids, self.f1, self.comps, self.centres, self.sides = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "f1", "comp", "centre", "side"))
        self.band = rows.column("band")[0].as_py()
        self.sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)

    def survivors(self, least: tuple[int, ...]) -> Iterable[tuple[int, np.ndarray]]:
        """For each row i: the later rows j that pruning leaves, best first.

        Left out are pairs of one side (of sides 0 and 1; -1 meets all), of one component, of a class and the centre that it has
        met, and pairs that agree on an earlier band, which are that band's.
        """
        sigs, band = self.sigs, self.band
        for i in range(len(sigs) - 1):
            apart = self.comps[i + 1 :] != self.comps[i]
            if self.sides[i] >= 0:
                apart &= self.sides[i + 1 :] != self.sides[i]
            apart &= (self.centres[i + 1 :] != self.ids[i]) & (self.ids[i + 1 :] != self.centres[i])
            j = np.flatnonzero(apart) + (i + 1)
            matches, done = np.zeros(len(j), np.int32), 0
            for to, m in zip(BATCHES, least):
                if not len(j):
                    break
                matches = matches + (sigs[j, done:to] == sigs[i, done:to]).sum(1)
                keep = matches >= m
                j, matches, done = j[keep], matches[keep], to
            if len(j) and band:
                earlier = (sigs[j, : band * ROWS] == sigs[i, : band * ROWS]).reshape(len(j), band, ROWS).all(2).any(1)
                j, matches = j[~earlier], matches[~earlier]
            if len(j):
                yield i, j[np.argsort(-matches, kind="stable")]


def _groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterable[pa.Table]:
    """Consecutive rows with equal values of `by`, across batches; a block holds at most 2 * BLOCK rows."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        columns = [batch.column(b).to_numpy(zero_copy_only=False) for b in by]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, int)
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            if a == b:
                continue
            now = tuple(c[a] for c in columns)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def similar_enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) <= len(b) else int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(documents: DataFrame, percent: int = 85, miss: float = 1e-4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Texts are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct 5-word shingles (fewer words:
    the whole sequence; none or null: empty set, linked with nothing). component_id is the smallest doc_id reachable by
    links, kept says that the document is that one. miss: probability at which a pair is given up during comparison; what
    banding itself may lose is below 3e-7 at similarity 0.85 and below 4e-5 at 0.8. Rows with a null doc_id come back unlinked. Rows
    that repeat a doc_id are one document of the graph, linked by any of their texts. Texts of any length are taken whole, an
    empty table gives an empty one, equal similarities link alike. Other columns play no part.
    """
    least = tuple(least_matches(n, percent / 100, miss) for n in BATCHES)
    docs = with_texts(documents)
    seen = written(mapped(docs, _summaries, _SETS, HASHED), "sets")
    known = seen.filter("n_shingles > 0 and doc_id is not null")
    classes = written(known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "classes")
    banded = classes.select("id", "f1", F.posexplode("keys").alias("band", "key"))
    full = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1")
    met = written(banded.join(full.drop("n"), "key"), "buckets")

    def needed(batches):
        for rows in _groups(batches, BY):
            use = np.zeros(rows.num_rows, dtype=bool)
            for i, j in Block(rows).survivors(least):
                use[i] = True
                use[j] = True
            if use.any():
                yield from rows.filter(pa.array(use)).combine_chunks().to_batches()

    def verified(batches):
        for rows in _groups(batches, BY):
            sets = []
            for part in rows.select(["text"]).to_batches():
                for piece in pieces(part, HASHED):
                    sets += shingle_sets(piece.column("text"))
            # Where rows repeat a doc_id with other texts, the join has brought those, too.
            own = _prints(sets)[0] == rows.column("f1").to_numpy()
            if not own.all():
                rows, sets = rows.filter(pa.array(own)), [s for s, o in zip(sets, own) if o]
            if not rows.num_rows:
                continue
            block = Block(rows)
            root = list(range(len(sets)))

            def top(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, js in block.survivors(least):
                for j in js.tolist():
                    a, b = top(i), top(j)
                    if a != b and similar_enough(sets[i], sets[j], percent):
                        root[max(a, b)] = min(a, b)  # rows are in order of id: the root is the smallest
            tops = np.array([top(x) for x in range(len(sets))])
            linked = tops != np.arange(len(sets))
            if linked.any():
                yield pa.record_batch({"a": pa.array(block.ids[tops[linked]]), "b": pa.array(block.ids[linked])})

    def links(members: DataFrame) -> DataFrame:
        """Verified links between the members of each block. Signatures travel first, texts only of those that pruning leaves."""
        dealt = members.join(classes.select("id", "f1", "sig"), ["id", "f1"]).repartition(*BY).sortWithinPartitions(*BY, "id")
        asked = written(dealt.select(*_MEMBER, "sig").mapInArrow(released(needed), f"{_MEMBERS}, sig binary"), "candidates")
        ids = asked.select(F.col("id").alias("doc_id")).distinct()
        wanted = docs.join(small(ids), "doc_id", "left_semi").withColumnRenamed("doc_id", "id")
        to_verify = asked.join(wanted, "id").repartition(*BY).sortWithinPartitions(*BY, "id")
        return written(to_verify.select(*_MEMBER, "sig", "text").mapInArrow(released(verified), "a long, b long"), "links")

    def chunk(n: Column) -> Column:
        return F.pmod(F.xxhash64("id", "f1", "key"), F.greatest(n, F.lit(1))).cast("int")

    def places(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    # The first pass: each class and the smallest member of its buckets, dealt out by centre in chunks.
    star = met.filter("id > first").groupBy("id", "f1").agg(F.min("first").alias("key"))
    centres = star.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("chunks"))
    of_star = lambda side, i: (F.lit(0).alias("band"), "key", i.alias("i"), F.lit(0).alias("j"), F.lit(side).alias("side"), F.col("id").alias("comp"), F.lit(NO_ID).alias("centre"))
    outer = star.join(centres, "key").select("id", "f1", *of_star(1, chunk(F.col("chunks"))))
    inner = classes.select("id", "f1", F.col("id").alias("key")).join(centres, "key").withColumn("place", places(F.col("chunks"))).select("id", "f1", *of_star(0, F.col("place")))
    first = links(outer.unionByName(inner))
    label = components(first).withColumnRenamed("component", "comp")

    # The second pass: buckets of several components. Chunks of the largest one have negative numbers.
    named = met.join(label, "id", "left").join(star.select("id", "f1", F.col("key").alias("centre")), ["id", "f1"], "left")
    named = named.select("id", "f1", "band", "key", F.coalesce("comp", "id").alias("comp"), F.coalesce("centre", F.lit(NO_ID)).alias("centre"))
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    chunks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("key", F.col("most.comp").alias("largest"), chunks(F.col("most.n")).alias("big"), chunks(F.col("n") - F.col("most.n")).alias("rest"))
    left = named.join(mixed, "key").withColumn("inside", F.col("comp") == F.col("largest")).withColumn("own", F.when(F.col("inside"), -1 - chunk(F.col("big"))).otherwise(chunk(F.col("rest"))))
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(-F.col("big"), F.col("rest") - 1))
    left = left.withColumn("with", F.explode(others)).withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with"))
    left = left.withColumn("side", F.when(F.col("i") == F.col("j"), -1).otherwise((F.col("own") == F.col("j")).cast("int")))
    second = links(left.select(*_MEMBER))
    again = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    same = known.select("doc_id", "f1", "f2", "n_shingles").join(again, "doc_id", "left_semi").join(classes.select("f1", "f2", "n_shingles", "id"), ["f1", "f2", "n_shingles"])
    found = components(first.union(second).union(same.select("doc_id", "id").filter("doc_id <> id")))
    groups = classes.join(found, "id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = seen.join(groups, ["f1", "f2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(documents: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group of near_duplicates(), that with the smallest doc_id, with all its columns. Of rows that repeat a doc_id, one stays; rows with a null doc_id all stay."""
    found = near_duplicates(documents, percent)
    gone = found.filter("not kept").select("doc_id").distinct()
    left = documents.join(small(gone), "doc_id", "left_anti").select(documents.columns)
    again = small(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    return left.join(again, "doc_id", "left_anti").select(documents.columns).union(left.join(again, "doc_id", "left_semi").select(documents.columns).dropDuplicates(["doc_id"]))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `documents`, linked at 85 %; see near_duplicates() for nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""
    return near_duplicates(table(spark, sf_dir, "documents"))
