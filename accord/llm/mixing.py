"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Seats go to the source with the highest quotient target / (2 * seats + 1), then within a source to its shards by their words
in the same way, so every shard has an integer quota. A seat is a block of one word: with longer ones, sources of a few words
would miss their targets. A shard's documents stand in a seeded order and are cut into runs of BLOCK words, the last of them
shorter; a quota of q over n words takes every word q div n times, and once more the q mod n words that come first when a
seeded permutation orders the runs (the last run taken in part).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from math import ceil, gcd, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accord.llm.common import mapped, small, table, written

BLOCK = 32
#: Words of a shard of a source of up to FEW_SHARDS shards; beyond, both their number and their words grow with the square root of the source.
SHARD_WORDS, FEW_SHARDS, ROOT = 1 << 17, 4096, 16
#: No source goes beyond so many times its words.
MOST_TIMES = 3
#: One row a source goes through the driver, for the order by code point and the targets; more sources than this are an error.
MOST_SOURCES = 1_000_000
#: Put before the names of carried columns, so that they clash with none of the mix's own.
CARRIED = "carried__"
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Words of each source: shares of all words by weight, none above MOST_TIMES its size; what is above is shared anew by weight among the rest."""
    left, out, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > MOST_TIMES * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(MOST_TIMES * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def apportioned(weights: list[float], seats: int) -> list[int]:
    """Sainte-Lague: each seat to the highest weight / (2 * seats so far + 1), ties to the earlier. Starts at the rounded shares and moves the few seats that differ."""
    total = sum(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    got = [int(w * seats / total + 0.5) for w in weights]
    short = seats - sum(got)
    if short > 0:
        heap = [(-w / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights, got)) if w > 0]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-weights[i] / (2 * got[i] + 1), i))
    elif short < 0:
        heap = [(w / (2 * k - 1), -i) for i, (w, k) in enumerate(zip(weights, got)) if k > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heap[0]
            got[-i] -= 1
            if got[-i]:
                heapq.heapreplace(heap, (weights[-i] / (2 * got[-i] - 1), i))
            else:
                heapq.heappop(heap)
    return got


def shards_of(words: int) -> int:
    """Shards of a source: SHARD_WORDS words each, until their square root is the greater number."""
    few = ceil(words / SHARD_WORDS)
    return max(1, few if few <= FEW_SHARDS else max(FEW_SHARDS, isqrt(words) // ROOT))


def _quotas(shards: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Quotas of one source's shards, and the permutation b -> (step * b + shift) mod blocks of each; last: the place of its last block."""
    shards = shards.sort_values("shard")
    words = shards["words"].tolist()
    rows = []
    for shard, n, quota in zip(shards["shard"].tolist(), words, apportioned([float(w) for w in words], int(shards["seats"].iloc[0]))):
        blocks, quota = ceil(n / BLOCK), min(quota, MOST_TIMES * n)
        random = np.random.default_rng([seed, int(shards["place"].iloc[0]), shard])
        step = int(random.integers(1, blocks + 1))
        while gcd(step, blocks) != 1:
            step += 1
        shift = int(random.integers(0, blocks))
        rows.append((int(shards["place"].iloc[0]), shard, n, blocks, quota // n, quota % n, step, shift, ((blocks - 1) * step + shift) % blocks))
    return pd.DataFrame(rows, columns=["place", "shard", "words", "blocks", "full", "rest", "step", "shift", "last"])


def mixed(documents: DataFrame, carried: tuple[str, ...] = (), seed: int = 20, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken, full, ranges of every document, and the carried columns, their names behind CARRIED.

    size: words of the whole text (null: 0). Sources in order of code points, null last, weigh `weights` in turn. taken: words
    that the mix takes, counting repeats: `full` times the whole document, and once more the word ranges [from, to) in `ranges`.
    The words taken of a source are its target, rounded. A document without words is not taken. Repeated rows are documents of
    their own, side by side; rows without a doc_id are ordered by their texts. A source's shards are many (shards_of), so a
    source of a third of all rows is dealt over many tasks. Columns other than doc_id, source and text play no part. Without
    rows or words, nothing is taken.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.xxhash64(F.col("doc_id").cast("long"), text, F.lit(seed))
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), order.alias("order"), *[F.col(c).alias(f"{CARRIED}{c}") for c in carried])
    totals = base.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(totals))])
    seats = apportioned(goal, round(sum(goal)))
    shards = [shards_of(n) for n in sizes]
    schema = "source string, place int, source_size long, target double, seats long, shards int"
    sources = spark.createDataFrame([(r["source"], i, sizes[i], goal[i], seats[i], shards[i]) for i, r in enumerate(totals)], schema)
    sources = small(sources, len(totals))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source").withColumn("shard", F.pmod(F.xxhash64("order", F.lit(seed + 1)), F.col("shards")).cast("int"))

    held = placed(base.select("source", "size", "order")).groupBy("place", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats")).filter("words > 0")
    kind = "place int, shard int, words long, blocks long, full long, rest long, step long, shift long, last long"
    quotas = written(held.groupBy("place").applyInPandas(lambda x: _quotas(x, seed), kind), "quotas")
    run = Window.partitionBy("place", "shard").orderBy("order", "doc_id", "size", *[f"{CARRIED}{c}" for c in carried]).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed(base).withColumn("end", F.sum("size").over(run)).withColumn("begin", F.col("end") - F.col("size"))
    rows = rows.join(small(quotas), ["place", "shard"], "left")
    short = F.col("blocks") * BLOCK - F.col("words")  # what the last block lacks

    def part(b):
        """The words of block b that are taken once more, as far as they stand in the document."""
        place = (b * F.col("step") + F.col("shift")) % F.col("blocks")
        before = place * BLOCK - F.when(place > F.col("last"), short).otherwise(0)  # words of the blocks that come first
        to = F.least(b * BLOCK + F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.lit(BLOCK)), F.col("words"), F.col("end"))
        return F.struct((F.greatest(b * BLOCK, F.col("begin")) - F.col("begin")).alias("from"), (to - F.col("begin")).alias("to"))

    blocks = F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    ranges = F.filter(F.transform(blocks, part), lambda r: r["to"] > r["from"])
    none = F.array().cast("array<struct<from: bigint, to: bigint>>")
    rows = rows.withColumn("ranges", F.when((F.col("size") > 0) & (F.col("rest") > 0), ranges).otherwise(none))
    more = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["to"] - r["from"])
    taken = F.when(F.col("size") > 0, F.col("full") * F.col("size") + more).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.coalesce("full", F.lit(0)).cast("int").alias("full"), "ranges", *[f"{CARRIED}{c}" for c in carried])


def mixture(documents: DataFrame, seed: int = 20) -> DataFrame:
    """The mix itself, with the columns of documents: a document that is taken `full` times stands so often with its whole text, and once more with the chosen word ranges, if any.

    Documents without words (null, empty, blank) are in no mix. Rows that repeat a doc_id are taken each on their own. Without
    rows the mix is empty. n_chars, if there is one, is counted anew; all other columns are carried along.
    """
    names = documents.columns
    rows = mixed(documents, tuple(names), seed).filter("full > 0 or size(ranges) > 0")

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        keep, made = [], []
        texts = batch.column(f"{CARRIED}text").to_pylist()
        for i, (text, full, ranges) in enumerate(zip(texts, batch.column("full").to_pylist(), batch.column("ranges").to_pylist())):
            keep += [i] * full
            made += [text] * full
            if ranges:
                keep.append(i)
                made.append(cut(text, [(r["from"], r["to"]) for r in ranges]))
        out = batch.select([f"{CARRIED}{c}" for c in names]).take(pa.array(keep, pa.int64()))
        at = names.index("text")
        columns = [*out.columns[:at], pa.array(made, pa.string()), *out.columns[at + 1 :]]
        if "n_chars" in names:
            k = names.index("n_chars")
            columns[k] = pa.array([None if x is None else len(x) for x in made], pa.int64()).cast(columns[k].type)
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(rows.select(*[f"{CARRIED}{c}" for c in names], "full", "ranges"), run, documents.schema)


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of the ranges with the white space between them; what lies between two ranges becomes a line end."""
    data = text.encode()
    spans = [m.span() for m in _WORD.finditer(data)]
    joined: list[list[int]] = []
    for a, b in ranges:
        if joined and joined[-1][1] == a:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return "\n".join(data[spans[a][0] : spans[b - 1][1]].decode() for a, b in joined)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, full of every row of `documents`; see mixed() for nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""
    return mixed(table(spark, sf_dir, "documents")).drop("ranges")
